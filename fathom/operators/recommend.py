"""Recommendations (M1-M11): parse, upsert, ALS, top unrated items per user.

No driver-side collections of ratings or factors and no per-user jobs: blocks
of users meet blocks of items, each pair gives every user's best unrated
items of the block, and one ranking per user merges them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.session import scratch_path


def _ratings_parsed(lines: DataFrame, line_col: str) -> DataFrame:
    parts = F.split(F.col(line_col), "::")
    as_int = lambda i: F.expr(f"try_cast(trim(element_at(split(`{line_col}`, '::'), {i})) AS INT)")
    return lines.select("*", as_int(1).alias("user_id"), as_int(2).alias("item_id"), as_int(3).alias("rating"),
                        F.size(parts).alias("_n"))


def parse_ratings(lines: DataFrame, line_col: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """M1: ``user::item::rating[::...]`` -> ints; extra fields are ignored and
    bad lines go to :func:`rating_rejects` instead of failing the job."""
    p = _ratings_parsed(lines, line_col)
    ok = (F.col("_n") >= 3) & F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & F.col("rating").isNotNull()
    return p.where(ok).select(*keep, "user_id", "item_id", "rating")


def rating_rejects(lines: DataFrame, line_col: str = "line") -> DataFrame:
    p = _ratings_parsed(lines, line_col)
    ok = (F.col("_n") >= 3) & F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & F.col("rating").isNotNull()
    return p.where(~ok).select(line_col)


def _item_lines(texts: DataFrame, text_col: str) -> DataFrame:
    lines = texts.select(F.explode(F.split(F.trim(F.col(text_col)), r"[\r\n]+")).alias("line"))
    lines = lines.select(F.trim("line").alias("line")).where(F.col("line") != "")
    parts = F.split("line", "::")
    return lines.select("line", F.expr("try_cast(element_at(split(line, '::'), 1) AS INT)").alias("item_id"),
                        F.element_at(parts, 1).alias("_id"),
                        F.when(F.size(parts) >= 2, F.element_at(parts, 2)).alias("title"))


def parse_items(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """M2: uploads split on CR/LF runs, lines trimmed, ``id::title``. A line with
    an empty or non-numeric id or an empty title is reported by
    :func:`item_rejects` (the reference rejects the whole upload)."""
    p = _item_lines(texts, text_col)
    return p.where(F.col("item_id").isNotNull() & (F.coalesce(F.col("title"), F.lit("")) != "")) \
        .select("item_id", "title")


def item_rejects(texts: DataFrame, text_col: str = "text") -> DataFrame:
    p = _item_lines(texts, text_col)
    return p.where(F.col("item_id").isNull() | (F.coalesce(F.col("title"), F.lit("")) == "")).select("line")


def upsert_ratings(ratings: DataFrame, order_col: str = "seq") -> DataFrame:
    """M3: one row per (user, item): the rating of the latest write by
    ``order_col``; writes tied on ``order_col`` resolve to the larger rating,
    so the result does not depend on partitioning."""
    return ratings.groupBy("user_id", "item_id").agg(
        F.max_by("rating", F.struct(order_col, "rating")).alias("rating"))


def implicit_confidence(ratings: DataFrame, implicit: bool = False) -> DataFrame:
    """M4: rating as double; in implicit mode ``rating - 2.5``."""
    r = F.col("rating").cast("double")
    return ratings.withColumn("rating", r - F.lit(2.5) if implicit else r)


def rating_stats(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """M5: ratings, distinct users, distinct rated items, items in the dictionary."""
    n_items = items.count()
    return ratings.agg(F.count(F.lit(1)).alias("n_ratings"), F.count_distinct("user_id").alias("n_users"),
                       F.count_distinct("item_id").alias("n_items_rated"), F.lit(n_items).alias("n_items"))


def train_als(ratings: DataFrame, rank: int = 10, max_iter: int = 10, reg: float = 1.0, implicit: bool = False,
              alpha: float = 1.0, user_blocks: int = 10, item_blocks: int = 10, seed: int = 42,
              checkpoint_interval: int = 1) -> ALSModel:
    """M6: Spark ML ALS on (user_id, item_id, rating); implicit mode maps the
    ratings through :func:`implicit_confidence`. It checkpoints to the
    session's shared checkpoint folder every ``checkpoint_interval`` iterations; that also drops the shuffle files of the
    iterations before, which else stay on disk until the training has ended.

    The ratings that ALS keeps in blocks for all iterations, and the factors, are kept on disk: a block is read whole by
    one task at a time, and in memory all of them stood beside the tasks that build the next ones."""
    from fathom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(ratings.sparkSession)
    data = implicit_confidence(ratings, implicit).select("user_id", "item_id", "rating")
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, implicitPrefs=implicit, alpha=alpha,
              numUserBlocks=user_blocks, numItemBlocks=item_blocks, userCol="user_id", itemCol="item_id",
              ratingCol="rating", coldStartStrategy="drop", seed=seed, checkpointInterval=checkpoint_interval,
              intermediateStorageLevel="DISK_ONLY", finalStorageLevel="DISK_ONLY")
    return als.fit(data)


def unrated_candidates(ratings: DataFrame, items: DataFrame, user_id) -> DataFrame:
    """M7 for one user: dictionary items the user has not rated; none for a user without a rating. The user's one
    row, if there is any, meets every dictionary item that no rating of theirs names."""
    mine = ratings.where(F.col("user_id") == F.lit(user_id))
    unrated = items.select("item_id").distinct().join(mine.select("item_id").distinct(), "item_id", "left_anti")
    known = mine.select("user_id").limit(1)
    return unrated.withColumn("user_id", F.lit(user_id).cast("int")).join(known, "user_id", "left_semi").select("user_id", "item_id")


def unrated_candidate_counts(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """M7 for every user with a rating: how many dictionary items they have not
    rated. Counted, not enumerated: |dictionary| minus the user's distinct
    rated items that are in the dictionary.

    The ratings meet the dictionary once; where they are dealt out by item for that, a pair's repeats are in one task
    already. Marks are summed per user."""
    dict_items = items.select("item_id").distinct().withColumn("_known", F.lit(1))
    n_dict = dict_items.count()
    rated = ratings.select("user_id", "item_id").join(dict_items, "item_id", "left")
    pairs = rated.groupBy("item_id", "user_id").agg(F.max("_known").alias("_known"))
    return pairs.groupBy("user_id").agg((F.lit(n_dict) - F.coalesce(F.sum("_known"), F.lit(0))).alias("n_candidates"))


def score_candidates(model: ALSModel, candidates: DataFrame) -> DataFrame:
    """M8: predicted score of each (user, item); pairs without factors are dropped."""
    return model.transform(candidates.select("user_id", "item_id")) \
        .select("user_id", "item_id", F.col("prediction").alias("score"))


USERS, ITEMS = 262_144, 500_000  # users and items of a group, at most on average
FIRST = 65_536  # items of the first round, about


def top_items_per_user(model: ALSModel, ratings: DataFrame, items: DataFrame, k: int = 20, block_items: int = ITEMS,
                       block_users: int = USERS, spread: int = 32, first_items: int = FIRST) -> DataFrame:
    """M8 + M9: for every user with ratings, the ``k`` best-scored dictionary items they have not rated (ties: item id
    ascending), with rank 1..k.

    Rounds of a block join (:func:`_meet`). Dictionary items with factors are taken by length of their factors, longest
    first: about ``first_items``, then stretches of eight times the one before. After a round a user's ``k``-th best score is
    the threshold for the next, and a user for whom no product with what is left can reach it (Cauchy-Schwarz, with room
    for rounding) is done; the others go on. Exact, however many items someone rated and however many users go on.

    All rows are dealt, met and read by Spark: no factor reaches the driver. What is written grows with users x ``k``, and
    with users that go on x blocks x ``k``."""
    spark = ratings.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    length = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("length")
    rated = stored(ratings.select("user_id", "item_id").distinct(), "rated")  # read several times, made once
    known = stored(model.itemFactors.join(items.select(F.col("item_id").alias("id")).distinct(), "id", "left_semi")
                   .select(F.col("id").alias("item_id"), "features", length), "known-items")
    users = stored(model.userFactors.withColumnRenamed("id", "user_id").join(rated.select("user_id").distinct(), "user_id", "left_semi")
                   .select("user_id", "features", length, F.lit(float("-inf")).cast("float").alias("least")), "known-users")
    w = Window.partitionBy("user_id").orderBy(F.col("score").desc(), F.col("item_id").asc())
    ranked = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    n, ends = known.count(), [first_items]
    while ends[-1] < n:
        ends.append(8 * ends[-1])
    meet = lambda some, part, mine: _meet(some, part, mine, k, block_items, block_users, spread)
    if len(ends) == 1:
        return ranked(meet(users, known.drop("length"), rated))
    cuts = known.agg(F.percentile_approx("length", [1 - end / n for end in ends[:-1]])).first()[0]
    room = 1 + 1e-6 * model.rank
    alive, best, longest = users, None, None
    for cut in [*cuts, None]:
        if longest is not None:
            least = best.where(F.col("rank") == k).select("user_id", F.col("score").alias("least"))
            alive = users.drop("least").join(least, "user_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")).cast("float")))
            alive = stored(alive.where(F.col("length") * F.lit(longest * room) >= F.col("least").cast("double")), "going-on")
            if alive.isEmpty():
                break
        low = F.lit(True) if cut is None else F.col("length") >= F.lit(cut)
        part = stored(known.where(low if longest is None else low & (F.col("length") < F.lit(longest))).select("item_id", "features"), "stretch")
        ids, mine = part.select("item_id"), rated
        mine = mine.join(F.broadcast(ids) if part.count() <= 4 * FIRST else ids, "item_id", "left_semi")
        if best is None:
            best = stored(ranked(meet(alive, part, mine)), "best")
        else:
            who = alive.select("user_id")
            found = meet(alive, part, mine.join(who, "user_id", "left_semi"))
            again = ranked(found.unionByName(best.drop("rank").join(who, "user_id", "left_semi")))
            best = stored(best.join(who, "user_id", "left_anti").unionByName(again), "best")
        longest = cut
    return best


def _meet(users: DataFrame, items: DataFrame, rated: DataFrame, k: int, block_items: int, block_users: int, spread: int) -> DataFrame:
    """``user_id, item_id, score``: each user's ``k`` best unrated items of every block of items, those below the user's
    ``least`` left out.

    Users are dealt by hash into lanes of about ``block_users`` (at least ``spread`` lanes, so that few users still give work
    to many tasks), items into blocks of about ``block_items``. A lane and a block meet in one group, with the ratings that
    their pairs have (:func:`_block_scores`): a task holds one lane's users, one block's items and a bounded piece of their
    scores. A block is large because the best of it are found with a threshold that rises on the way, not by a selection
    from all scores."""
    n_items, n_users = items.count(), users.count()
    blocks = max(1, -(-n_items // block_items))
    lanes = max(1, min(spread, n_users), -(-n_users // block_users))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")
    lane = F.pmod(F.xxhash64("user_id"), F.lit(lanes)).cast("int").alias("lane")
    # a row of a user has factors, one of a rating an item
    left = users.select(lane, every(blocks).alias("block"), "user_id", "features", "least", F.lit(None).cast("int").alias("item_id")).unionByName(
        rated.select(lane, block, "user_id", F.lit(None).cast("array<float>").alias("features"), F.lit(None).cast("float").alias("least"), "item_id"))
    packs = max(1, -(-min(block_items, n_items) // 4096))
    packed = items.groupBy(block, F.pmod(F.hash("item_id"), F.lit(packs)).alias("row")) \
        .agg(F.collect_list(F.struct("item_id", "features")).alias("items"))
    right = packed.select(every(lanes).alias("lane"), "block", F.transform("items", lambda x: x["item_id"]).alias("ids"),
                          F.flatten(F.transform("items", lambda x: x["features"])).alias("features"))
    return left.groupBy("lane", "block").cogroup(right.groupBy("lane", "block")) \
        .applyInArrow(_block_scores(k), "user_id int, item_id int, score float")


def _block_scores(k: int, users_at_once: int = 256, items_at_once: int = 1024, gather: int = 1 << 20):
    """The ``k`` best unrated items of a block per user of a lane. Items are taken by length of their factors, longest
    first, in stretches that double; after each one a user's ``k``-th best score is the threshold for the next, and a user
    for whom no product with what is left can reach it (Cauchy-Schwarz, with room for rounding) is done. ``least``, where the
    lane has it, is the threshold that a user begins with."""
    out = pa.schema([("user_id", pa.int32()), ("item_id", pa.int32()), ("score", pa.float32())])
    lowest = np.float32(-np.inf)

    def best(who: np.ndarray, ids: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Places of each user's first ``k`` by score descending, id ascending; users ascending."""
        order = np.lexsort((ids, -score, who))
        w = who[order]
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1])[:len(w)])
        return order[np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w)))) < k]

    def factors(lists: pa.ChunkedArray, n: int) -> np.ndarray:
        flat = lists.combine_chunks().flatten() if n else pa.array([], pa.float32())
        return flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(n, -1) if n else np.zeros((0, 1), np.float32)

    def length(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))

    def chunk(x, xn, least, items, y, yn, struck, buffer, flags) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best items of a few users; ``struck``: sorted places (user * number of items + item) of rated pairs;
        ``buffer``, ``flags``: scores and marks of one step (memory that is used again, new memory costs more than the product)."""
        n, room = len(items), 1 + 1e-6 * x.shape[1]
        who, what, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)

        def merge(found) -> None:
            nonlocal who, what, score
            w, i, s = (np.concatenate([a, *b]) for a, b in zip((who, what, score), zip(*found)))
            keep = best(w, items[i], s)
            who, what, score = w[keep], i[keep], s[keep]
            count = np.bincount(who, minlength=len(x))
            full = count >= k
            least[full] = np.maximum(least[full], score[np.cumsum(count)[full] - 1])

        at, upto = 0, items_at_once
        while at < n:
            live = np.flatnonzero(xn * yn[at] * room >= least)
            if not len(live):
                break
            found, size, mine = [], 0, x[live]
            for i in range(at, min(upto, n), items_at_once):
                part = y[i:min(i + items_at_once, upto, n)]
                shape = len(mine), len(part)
                cells = shape[0] * shape[1]
                scores = np.matmul(mine, part.T, out=buffer[:cells].reshape(shape))
                if not at:  # a first threshold; rated pairs count for nothing in it
                    row = np.full(len(x), -1)
                    row[live] = np.arange(len(live))
                    j = row[struck // n], struck % n
                    inside = (j[0] >= 0) & (j[1] < len(part))
                    scores[j[0][inside], j[1][inside]] = lowest
                    if len(part) >= k:
                        least[live] = np.maximum(least[live], np.partition(scores, len(part) - k, axis=1)[:, len(part) - k])
                w, c = np.divmod(np.flatnonzero(np.greater_equal(scores, least[live, None], out=flags[:cells].reshape(shape))), len(part))
                s = scores[w, c]
                w, c = live[w], c + i
                if len(struck):
                    place = w * n + c
                    free = struck[np.minimum(np.searchsorted(struck, place), len(struck) - 1)] != place
                    w, c, s = w[free], c[free], s[free]
                found.append((w, c, s))
                size += len(w)
                if size > gather:  # many equal scores
                    merge(found)
                    found, size = [], 0
            if found:
                merge(found)
            at, upto = upto, 2 * upto
        return who, what, score

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.column("item_id").is_null()
        u, r = left.filter(rows), left.filter(left.column("item_id").is_valid())
        users, items = u.column("user_id").to_numpy(), right.column("ids").combine_chunks().flatten().to_numpy() if right.num_rows else np.zeros(0, np.int32)
        if not len(users) or not len(items):
            return out.empty_table()
        x, y = factors(u.column("features"), len(users)), factors(right.column("features"), len(items))
        least = u.column("least").to_numpy() if "least" in u.column_names else np.full(len(users), lowest)
        order = np.argsort(users)
        users, x, least = users[order], x[order], least[order]
        yn = length(y)
        order = np.argsort(-yn, kind="stable")
        items, y, yn = items[order], y[order], yn[order]
        xn = length(x)
        # rated pairs of known users and items, as places
        ru, ri = (r.column(c).to_numpy() for c in ("user_id", "item_id"))
        by_id = np.argsort(items)
        pu, pi = np.searchsorted(users, ru), np.searchsorted(items, ri, sorter=by_id)
        ok = (pu < len(users)) & (pi < len(items))
        ok[ok] = (users[pu[ok]] == ru[ok]) & (items[by_id[pi[ok]]] == ri[ok])
        struck = np.sort(pu[ok] * len(items) + by_id[pi[ok]])
        got = []
        buffer, flags = (np.empty(users_at_once * items_at_once, t) for t in (np.float32, bool))
        for at in range(0, len(users), users_at_once):
            end = min(at + users_at_once, len(users))
            lo, hi = np.searchsorted(struck, (at * len(items), end * len(items)))
            who, what, score = chunk(x[at:end], xn[at:end], least[at:end], items, y, yn, struck[lo:hi] - at * len(items), buffer, flags)
            got.append((users[at + who], items[what], score))
        return pa.table([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*got), out)], schema=out)

    return run


def stored_recommendations(top: DataFrame) -> DataFrame:
    """Scores truncated toward zero to int, keyed (user, item)."""
    return top.select("user_id", "item_id", F.col("score").cast("int").alias("score"))


class RecommendationStore:
    """M10's store: one row per (user, item) in folders by user bucket, replaced user by user.

    ``put`` takes the recommendations of some users and replaces theirs: a user of ``users`` without any loses the old
    rows, all other users keep theirs. Only the folders of those users' buckets are written (dynamic partition
    overwrite); their other users' rows are staged in the shared folder first, so nothing is read while it is
    overwritten, and a failed ``put`` can be run again. A folder that loses its last user keeps a row without a user, as
    a folder for which nothing is written would stay as it was; readers never see that row. ``of_user`` opens one folder."""

    ROWS = "user_id int, item_id int, score int, bucket int"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, user) -> Column:
        return F.pmod(F.xxhash64(user), F.lit(self.buckets)).cast("int")

    def _table(self) -> DataFrame:
        return self.spark.read.schema(self.ROWS).parquet(self.path)

    def put(self, recommendations: DataFrame, users: DataFrame | None = None) -> None:
        """``recommendations``: ``user_id, item_id, score``; ``users`` (``user_id``): whose lists these are; without it
        the users that occur in them."""
        new = recommendations.select("user_id", "item_id", F.col("score").cast("int").alias("score"))
        users = (new if users is None else users).select(F.col("user_id").cast("int").alias("user_id")).distinct()
        # a new store has no folder to read yet; an empty append makes it
        self.spark.createDataFrame([], self.ROWS).write.mode("append").partitionBy("bucket").parquet(self.path)
        touched = [r[0] for r in users.select(self._bucket("user_id")).distinct().collect()]  # at most as many as buckets
        old = self._table().where(F.col("bucket").isin(touched) & F.col("user_id").isNotNull())
        kept = old.drop("bucket").join(users, "user_id", "left_anti")
        rows = kept.unionByName(new.join(users, "user_id", "left_semi")).withColumn("bucket", self._bucket("user_id"))
        marks = self.spark.createDataFrame([(None, None, None, b) for b in touched], self.ROWS)
        staged = scratch_path(self.spark, "recommendations")
        rows.unionByName(marks).write.parquet(staged)
        self.spark.read.schema(self.ROWS).parquet(staged).repartition("bucket").sortWithinPartitions("bucket", "user_id", "item_id") \
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def all(self) -> DataFrame:
        return self._table().where("user_id IS NOT NULL").select("user_id", "item_id", "score")

    def of_user(self, user_id: int) -> DataFrame:
        """One user's rows; the bucket is part of the filter, so only that folder is opened."""
        mine = self._table().where(F.col("bucket") == self._bucket(F.lit(user_id).cast("int")))
        return mine.where(F.col("user_id") == F.lit(user_id)).select("user_id", "item_id", "score")


def rated_titles(ratings_store: DataFrame, items: DataFrame) -> DataFrame:
    """The rated half of M11: ``user_id, list, item_id, title`` (title null when unknown); needs no model."""
    rated = ratings_store.select("user_id", "item_id").distinct().withColumn("list", F.lit("rated"))
    return rated.join(items.select("item_id", "title"), "item_id", "left").select("user_id", "list", "item_id", "title")


def recommendation_listing(ratings_store: DataFrame, recs: DataFrame, items: DataFrame) -> DataFrame:
    """M11 for all users, one row per entry: ``user_id, list ('rated' or
    'recommended'), item_id, title`` (title null when unknown), for users that
    have both ratings and recommendations. Item-id order is the row order
    within a list; long form keeps a heavy rater's list spread over rows."""
    titles = items.select("item_id", "title")
    rated = ratings_store.select("user_id", "item_id").distinct().withColumn("list", F.lit("rated"))
    recd = recs.select("user_id", "item_id").distinct().withColumn("list", F.lit("recommended"))
    both = rated.select("user_id").distinct().join(recd.select("user_id").distinct(), "user_id", "left_semi")
    rows = rated.unionByName(recd).join(both, "user_id", "left_semi").join(titles, "item_id", "left")
    return rows.select("user_id", "list", "item_id", "title")


def recommend_for_user(ratings_store: DataFrame, recs: DataFrame, items: DataFrame, user_id) -> DataFrame:
    """M11 for one user: ``user_id, rated, recommended`` title arrays in item-id
    order; no row when the user has no ratings or no recommendations."""
    one = recommendation_listing(ratings_store.where(F.col("user_id") == F.lit(user_id)),
                                 recs.where(F.col("user_id") == F.lit(user_id)), items)
    g = one.groupBy("user_id").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("list") == "rated", F.struct("item_id", "title")))),
                    lambda s: s["title"]).alias("rated"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("list") == "recommended", F.struct("item_id", "title")))),
                    lambda s: s["title"]).alias("recommended"))
    return g
