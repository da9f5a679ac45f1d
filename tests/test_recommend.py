import numpy as np
from pyspark.sql import functions as F

from fathom.operators import recommend as M


def test_reference_example(spark):
    ratings = M.parse_ratings(spark.createDataFrame([("0::0::3",), ("0::1::4",), ("1::1::4",), ("1::2::4::x",), ("bad",)],
                                                    "line string"))
    items = M.parse_items(spark.createDataFrame([("0::Zero\r\n1::One\n\n2::Two\r\n3::Three\r\n::nothing",)], "text string"))
    assert ratings.count() == 4 and items.count() == 4
    model = M.train_als(ratings, seed=1)
    top = M.top_items_per_user(model, ratings, items, k=20)
    got = sorted((r.user_id, r.item_id) for r in top.collect())
    assert got == [(0, 2), (1, 0)]  # item 3 was never rated: no factors, dropped
    rec = M.recommend_for_user(M.upsert_ratings(ratings.withColumn("seq", F.lit(0)), "seq"), top, items, 1).first()
    assert rec["rated"] == ["One", "Two"] and rec["recommended"] == ["Zero"]
    assert M.stored_recommendations(top).where("user_id = 0").first()["score"] == int(
        top.where("user_id = 0").first()["score"])


def test_top_items_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for u in range(30):
        n = 25 if u == 0 else int(rng.integers(1, 6))  # one heavy rater
        for i in rng.choice(40, size=n, replace=False):
            rows.append((u, int(i), int(rng.integers(1, 6))))
    ratings = spark.createDataFrame(rows, "user_id int, item_id int, rating int")
    items = spark.createDataFrame([(i, f"t{i}") for i in range(35)], "item_id int, title string")  # 35..39 not in dictionary
    model = M.train_als(ratings, max_iter=5, seed=3)
    k = 5
    top = {(r.user_id, r.item_id) for r in M.top_items_per_user(model, ratings, items, k).collect()}
    blocks = M.top_items_per_user(model, ratings, items, k, block_items=6, block_users=4, spread=3).collect()
    assert {(r.user_id, r.item_id) for r in blocks} == top
    assert all([r.rank for r in sorted(blocks, key=lambda r: (-r.score, r.item_id)) if r.user_id == u] == list(range(1, k + 1)) for u in (0, 7))
    uf = {r.id: np.array(r.features) for r in model.userFactors.collect()}
    itf = {r.id: np.array(r.features) for r in model.itemFactors.collect()}
    rated = {}
    for u, i, _ in rows:
        rated.setdefault(u, set()).add(i)
    expect = set()
    for u in rated:
        cand = [(-float(np.float32(uf[u] @ itf[i])), i) for i in itf if i < 35 and i not in rated[u]]
        expect |= {(u, i) for _, i in sorted(cand)[:k]}
    assert top == expect


def test_upsert_and_counts(spark):
    r = spark.createDataFrame([(1, 5, 2, 1), (1, 5, 4, 2), (1, 6, 3, 1), (2, 5, 1, 1)],
                              "user_id int, item_id int, rating int, seq int")
    s = {(x.user_id, x.item_id): x.rating for x in M.upsert_ratings(r, "seq").collect()}
    assert s == {(1, 5): 4, (1, 6): 3, (2, 5): 1}
    items = spark.createDataFrame([(5, "a"), (6, "b"), (7, "c")], "item_id int, title string")
    c = {x.user_id: x.n_candidates for x in M.unrated_candidate_counts(r, items).collect()}
    assert c == {1: 1, 2: 2}
    assert sorted(x.item_id for x in M.unrated_candidates(r, items, 2).collect()) == [6, 7]
    assert M.unrated_candidates(r, items, 9).count() == 0  # a user without a rating


def test_recommendation_store(spark, tmp_path):
    store = M.RecommendationStore(spark, str(tmp_path / "s"), buckets=4)
    schema = "user_id int, item_id int, score float"
    rows = lambda df: sorted(map(tuple, df.collect()))
    first = [(u, i, u + i / 10) for u in range(12) for i in range(3)]
    store.put(spark.createDataFrame(first, schema))
    assert rows(store.all()) == sorted((u, i, int(s)) for u, i, s in first)
    files = lambda: {f for f in store.all().inputFiles()}
    before = files()
    again = spark.createDataFrame([(3, 9, -1.9), (20, 1, 5.5), (4, 4, 1.0)], schema)
    users = spark.createDataFrame([(3,), (20,), (5,)], "user_id int")  # 5 has none any more; 4 is not to be replaced
    store.put(again, users)
    want = sorted([(u, i, int(s)) for u, i, s in first if u not in (3, 5)] + [(3, 9, -1), (20, 1, 5)])
    assert rows(store.all()) == want
    assert rows(store.of_user(20)) == [(20, 1, 5)] and store.of_user(5).count() == 0
    assert before & files() or len({f.split("bucket=")[1][0] for f in before}) <= 3  # folders of other buckets were left alone
    plan = store.of_user(3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    for u in range(21):
        store.put(again.where("false"), spark.createDataFrame([(u,)], "user_id int"))
    assert store.all().count() == 0
    store.put(spark.createDataFrame(first, schema))
    assert store.all().count() == 36


def test_keyed_table_opens_one_bucket(spark, tmp_path):
    from fathom.sources.tables import read_keyed, write_keyed

    df = spark.createDataFrame([(u, i) for u in range(50) for i in range(4)], "user_id int, item_id int")
    name = write_keyed(df, ["user_id", "item_id"], str(tmp_path / "t"), 8)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # which hides the buckets in the plan
    try:
        one = read_keyed(spark, name, user_id=7)
        assert "SelectedBucketsCount: 1 out of 8" in one._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    mine = {r[0].rsplit("/", 1)[1] for r in one.select(F.input_file_name()).distinct().collect()}
    assert len(mine) == 1
    for f in (tmp_path / "t").glob("*.parquet"):
        if f.name not in mine:
            f.write_bytes(b"not to be opened")
    assert sorted(r.item_id for r in read_keyed(spark, name, user_id=7).collect()) == [0, 1, 2, 3]


def _lane(users, items, rated=()):
    import pyarrow as pa

    lists = lambda x: pa.array(list(x), pa.list_(pa.float32()))
    left = pa.table({"user_id": pa.array([*range(len(users)), *(u for u, _ in rated)], pa.int32()),
                     "features": pa.chunked_array([lists([*users, *[None] * len(rated)])]),
                     "item_id": pa.array([*[None] * len(users), *(i for _, i in rated)], pa.int32())})
    right = pa.table({"ids": pa.chunked_array([pa.array([range(len(items))], pa.list_(pa.int32()))]),
                      "features": pa.chunked_array([lists([items.ravel()])])})
    return left, right


def test_no_more_than_k_rows_of_a_user_leave_a_block():
    # all scores are equal: those of the smallest ids stay, and ties do not leave the task
    left, right = _lane(np.ones((3, 2), np.float32), np.ones((5000, 2), np.float32), [(1, 0), (1, 3), (7, 1)])
    got = sorted(zip(*(c.to_pylist() for c in M._block_scores(4, gather=3000)(left, right).columns)))
    assert [(u, i) for u, i, _ in got] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 4), (1, 5), (2, 0), (2, 1), (2, 2), (2, 3)]


def test_block_scores_equal_brute_force():
    rng = np.random.default_rng(8)
    users, items = (rng.normal(size=(n, 3)).astype(np.float32) * rng.uniform(0, 2, (n, 1)).astype(np.float32) for n in (70, 3000))
    users[5], items[17] = 0, 0
    rated = [(int(u), int(i)) for u, i in zip(rng.integers(0, 70, 4000), rng.integers(0, 3000, 4000))]
    rated += [(6, i) for i in range(3000) if i != 9] + [(u, int(np.argmax(users[u] @ items.T))) for u in range(70)]
    left, right = _lane(users, items, rated)
    got = M._block_scores(7, users_at_once=16, items_at_once=64)(left, right).to_pylist()
    scores = users.astype(float) @ items.T.astype(float)
    scores[tuple(zip(*rated))] = -np.inf
    for u in range(70):
        mine = sorted((-r["score"], r["item_id"]) for r in got if r["user_id"] == u)
        want = np.sort(scores[u])[::-1][:min(7, int(np.isfinite(scores[u]).sum()))]
        assert len(mine) == len(want) == len({i for _, i in mine})
        assert np.allclose([-s for s, _ in mine], want, atol=1e-5)
        assert np.allclose([scores[u, i] for _, i in mine], want, atol=1e-5)


def test_one_user_queries_read_stored_ratings(spark, tmp_path, monkeypatch):
    from fathom.plans import rec as P

    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    write("orders", [(i, i % 3 + 1) for i in range(12)], "o_orderkey long, o_custkey long")
    spark.read.parquet(str(tmp_path / "orders.parquet")).selectExpr("*", "timestamp_ntz'2024-01-01' o_orderdate").write.parquet(str(tmp_path / "dated"))
    monkeypatch.setattr(P, "load", lambda s, sf, n: s.read.parquet(f"{sf}/dated" if n == "orders" else f"{sf}/{n}.parquet"))
    write("lineitem", [(i, (i * 5 + n) % 7, n, 10.0 * n) for i in range(12) for n in (1, 2)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double")
    write("part", [(i, f"p{i}", 5) for i in range(9)], "p_partkey long, p_name string, p_size int")
    seen, whole = [], M.unrated_candidates
    monkeypatch.setattr(P.M, "unrated_candidates", lambda r, *a: seen.append(r) or whole(r, *a))
    mine = {(i * 5 + n) % 7 for i in range(0, 12, 3) for n in (1, 2)}
    assert sorted(map(tuple, P.unrated_candidates_user(spark, str(tmp_path)).collect())) == [(1, i) for i in range(9) if i not in mine]
    scored = P.score_candidates_user(spark, str(tmp_path)).collect()
    assert sorted((r.user_id, r.item_id) for r in scored) == [(1, i) for i in range(7) if i not in mine] and all(r.is_product for r in scored)
    assert len(seen) == 2
    for ratings in seen:
        assert "Join" not in ratings._jdf.queryExecution().optimizedPlan().toString()


def _rating_tables(spark, tmp_path, monkeypatch):
    from fathom.plans import rec as P

    tables = {"orders": spark.createDataFrame([(i, i % 3 + 1) for i in range(12)], "o_orderkey long, o_custkey long").selectExpr("*", "timestamp_ntz'2024-01-01' o_orderdate"),
              "lineitem": spark.createDataFrame([(i, (i * 5 + n) % 7, n, 10.0 * n) for i in range(12) for n in (1, 2)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double"),
              "part": spark.createDataFrame([(i, f"p{i}", 5) for i in range(9)], "p_partkey long, p_name string, p_size int")}
    monkeypatch.setattr(P, "load", lambda s, sf, n: tables[n])
    joined, lines = [], P.standins.rating_lines
    monkeypatch.setattr(P.standins, "rating_lines", lambda *a, **k: joined.append(a) or lines(*a, **k))
    return P, joined


def test_listings_join_the_ratings_once(spark, tmp_path, monkeypatch):
    P, joined = _rating_tables(spark, tmp_path, monkeypatch)
    top = spark.createDataFrame([(1, 8, 2.5, 1), (2, 7, 1.5, 1)], "user_id int, item_id int, score float, rank int")
    monkeypatch.setattr(P.M, "train_als", lambda ratings: ratings.count())
    monkeypatch.setattr(P.M, "top_items_per_user", lambda *a: top)
    mine = {(i * 5 + n) % 7 for i in range(0, 12, 3) for n in (1, 2)}
    one = P.recommend_for_user(spark, "").collect()
    assert [tuple(r) for r in one] == [(1, "|".join(f"p{i}" for i in sorted(mine)), "p8")] and len(joined) == 1
    assert {(r.user_id, r.n, r.n_rated, r.n_unknown) for r in P.top_items_audit(spark, "").collect()} == {(1, 1, 0, 0), (2, 1, 0, 0)} and len(joined) == 2
    rows = P.recommendation_listing(spark, "").collect()
    assert len(joined) == 3 and {r.item_id for r in rows if r.user_id == 1 and r.list == "rated"} == mine


def test_unrated_counts_meet_the_dictionary_once(spark):
    ratings = spark.createDataFrame([(1, 1, 5), (1, 1, 4), (1, 2, 3), (1, 9, 3), (2, 9, 1), (3, 3, 1), (3, 1, 1), (3, 2, 2)], "user_id int, item_id int, rating int")
    items = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "item_id int, title string")
    got = M.unrated_candidate_counts(ratings, items)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 3), (3, 0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_training_holds_no_blocks_in_memory(spark, monkeypatch):
    ratings = spark.createDataFrame([(u, i, (u * i) % 5 + 1) for u in range(12) for i in range(8)], "user_id int, item_id int, rating int")
    kept = lambda: {k: r.getStorageLevel() for k, r in spark.sparkContext._jsc.getPersistentRDDs().items()}
    seen, fit, before = [], M.ALS.fit, set(kept())
    monkeypatch.setattr(M.ALS, "fit", lambda als, data: seen.append(als.getIntermediateStorageLevel()) or fit(als, data))
    model = M.train_als(ratings, max_iter=2)
    assert model.userFactors.count() == 12 and model.itemFactors.count() == 8
    factors = [level for k, level in kept().items() if k not in before]
    assert len(factors) >= 2 and not any(level.useMemory() for level in factors)
    assert seen == ["DISK_ONLY"]


def test_training_leaves_no_shuffle_files_of_past_iterations(spark):
    import time
    from pathlib import Path

    ratings = spark.createDataFrame([(u, i, (u * i) % 5 + 1) for u in range(12) for i in range(8)], "user_id int, item_id int, rating int")
    dirs = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    shuffles = lambda: {f.name.split("_")[1] for d in dirs for f in Path(d).rglob("shuffle_*.data")}
    before = shuffles()
    model = M.train_als(ratings, max_iter=9)
    assert model.itemFactors.count() == 8
    until = time.time() + 10
    while len(shuffles() - before) > 9 and time.time() < until:  # files are removed in the background
        time.sleep(0.2)
    assert len(shuffles() - before) <= 9  # those of the blocks and the last iteration; two for each iteration otherwise


def _skewed(rng, n, far):
    x = rng.normal(size=(n, 3)) * np.where(np.arange(n) % 10, 1, far)[:, None]
    return [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]


def test_rounds_by_length_equal_brute_force(spark, monkeypatch):
    """Some users end after the longest items; one who rated those goes on, and one of length 0 through all rounds."""
    from types import SimpleNamespace

    rng = np.random.default_rng(4)
    users, items = _skewed(rng, 40, 1), _skewed(rng, 200, 30)
    users[7] = (7, [0.0, 0.0, 0.0])
    frame = lambda rows: spark.createDataFrame(rows, "id int, features array<float>")
    model = SimpleNamespace(userFactors=frame(users), itemFactors=frame(items), rank=3)
    rated = [(int(u), int(i)) for u, i in zip(rng.integers(0, 40, 200), rng.integers(0, 200, 200))]
    rated += [(9, i) for i in range(0, 200, 10)] + [(u, 1) for u in range(40)]
    ratings = spark.createDataFrame(rated, "user_id int, item_id int")
    names = spark.createDataFrame([(i, "t") for i in range(190)], "item_id int, title string")
    met, meet = [], M._meet
    monkeypatch.setattr(M, "_meet", lambda some, *a: met.append({r[0] for r in some.select("user_id").collect()}) or meet(some, *a))
    got = M.top_items_per_user(model, ratings, names, 4, block_items=30, block_users=9, spread=3, first_items=12).collect()
    x, y = (np.array([f for _, f in rows], np.float64) for rows in (users, items))
    scores = x @ y.T
    scores[tuple(zip(*rated))] = -np.inf
    scores[:, 190:] = -np.inf
    for u in range(40):
        want = sorted((-s, i) for i, s in enumerate(scores[u]) if np.isfinite(s))[:4]
        mine = sorted((r["rank"], r["item_id"], r["score"]) for r in got if r["user_id"] == u)
        assert [i for _, i, _ in mine] == [i for _, i in want] and [r for r, _, _ in mine] == [1, 2, 3, 4]
        assert np.allclose([s for _, _, s in mine], [-s for s, _ in want], atol=1e-4)
    assert met[0] == set(range(40)) and 0 < len(met[1]) < 40 and {7, 9} <= met[1] and all(7 in m for m in met) and len(met) > 2


def test_rounds_of_equal_lengths(spark):
    """All items are equally long, so none can be told apart: the blocks stay small and nothing is lost."""
    from types import SimpleNamespace

    frame = lambda n: spark.createDataFrame([(i, [1.0, 1.0]) for i in range(n)], "id int, features array<float>")
    ratings = spark.createDataFrame([(u, u) for u in range(6)], "user_id int, item_id int")
    names = spark.createDataFrame([(i, "t") for i in range(50)], "item_id int, title string")
    got = M.top_items_per_user(SimpleNamespace(userFactors=frame(6), itemFactors=frame(50), rank=2), ratings, names, 3, block_items=8, first_items=10)
    assert sorted((r["user_id"], r["rank"], r["item_id"]) for r in got.collect()) == \
        [(u, rank, i) for u in range(6) for rank, i in enumerate([i for i in range(50) if i != u][:3], 1)]
