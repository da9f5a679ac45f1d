"""Registered recommendation queries: ratings are order lines
(user = customer, item = part, rating 1-5 from the quantity), titles are
part names. ALS-dependent results have no SQL oracle (row counts are still
deterministic: per user, min(k, unrated items with factors))."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.operators import recommend as M
from fathom.plans.registry import query
from fathom.session import scratch_path
from fathom.sources import standins
from fathom.sources.tables import load, read_keyed, write_keyed

RAT = """r AS (SELECT CAST(o_custkey AS INT) AS user_id, CAST(l_partkey AS INT) AS item_id,
                CAST(least(5, greatest(1, ceil(l_quantity / 10))) AS INT) AS rating,
                o_orderdate, l_orderkey, l_linenumber
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
STORE = """store AS (SELECT user_id, item_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id
            ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, rating DESC) AS rn FROM r) WHERE rn = 1)"""
ITEMS = "items AS (SELECT CAST(p_partkey AS INT) AS item_id, trim(p_name) AS title FROM part)"
ONE_USER = "(SELECT min(user_id) FROM r)"


def _ratings(spark, sf, keep=("seq",)):
    lines = standins.rating_lines(load(spark, sf, "orders"), load(spark, sf, "lineitem"))
    return M.parse_ratings(lines, keep=keep)


def _ratings_once(spark, sf, keep=()):
    """The ratings as a stored table, for jobs that read them several times: joined and parsed once, and a filter on
    the user skips row groups."""
    path = scratch_path(spark, "parsed-ratings")
    _ratings(spark, sf, keep).write.parquet(path)
    return spark.read.parquet(path)


def _items(spark, sf):
    return M.parse_items(standins.item_texts(load(spark, sf, "part")))


def _one_user(ratings) -> int:
    """The user of the one-user queries: the smallest id with a rating, so that no table size makes them empty."""
    return ratings.agg(F.min("user_id")).first()[0]


def _store(spark, sf):
    return M.upsert_ratings(_ratings(spark, sf), "seq")


def _model(spark, sf):
    return M.train_als(_ratings(spark, sf, keep=()))


def _top(spark, sf, k=20, ratings=None):
    """Recommendations, stored once: listings read the table as often as they need. ``ratings``: the stored ones of a
    job that reads them beside it."""
    ratings = _ratings_once(spark, sf) if ratings is None else ratings
    path = scratch_path(spark, "recommendations")
    M.top_items_per_user(M.train_als(ratings), ratings, _items(spark, sf), k).write.parquet(path)
    return spark.read.parquet(path)


# What a user's list must look like whatever the factors are: items with factors are those that someone rated.
DEPTH = """rated AS (SELECT DISTINCT user_id, item_id FROM r), known AS (SELECT DISTINCT item_id FROM items WHERE item_id IN (SELECT item_id FROM rated)),
depth AS (SELECT user_id, least(20, (SELECT count(*) FROM known) - count(CASE WHEN item_id IN (SELECT item_id FROM known) THEN 1 END)) AS n
          FROM rated GROUP BY user_id)"""


@query("rec_parse_ratings", sql=f"WITH {RAT} SELECT user_id, item_id, rating FROM r")
def parse_ratings(spark, sf):
    return _ratings(spark, sf, keep=())


@query("rec_rating_rejects", sql="""SELECT CASE l_linenumber WHEN 1 THEN 'u' || o_custkey || '::' || l_partkey || '::'
  || CAST(least(5, greatest(1, ceil(l_quantity / 10))) AS INT) || '::' || l_orderkey ELSE o_custkey || '::' || l_partkey END AS line
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 2""")
def rating_rejects(spark, sf):
    return M.rating_rejects(standins.rating_lines(load(spark, sf, "orders"), load(spark, sf, "lineitem"), damaged=True))


@query("rec_parse_items", sql=f"WITH {ITEMS} SELECT item_id, title FROM items")
def parse_items(spark, sf):
    return _items(spark, sf)


@query("rec_item_rejects", sql="""SELECT '::' || p_name AS line FROM part WHERE p_size < 10
UNION ALL SELECT p_partkey || '::' AS line FROM part WHERE p_size < 10""")
def item_rejects(spark, sf):
    return M.item_rejects(standins.item_texts(load(spark, sf, "part"), damaged=True))


@query("rec_upsert_ratings", sql=f"WITH {RAT}, {STORE} SELECT * FROM store")
def upsert_ratings(spark, sf):
    return _store(spark, sf)


@query("rec_implicit_confidence", sql=f"WITH {RAT} SELECT user_id, item_id, CAST(rating AS DOUBLE) - 2.5 AS rating FROM r")
def implicit_confidence(spark, sf):
    return M.implicit_confidence(_ratings(spark, sf, keep=()), implicit=True)


@query("rec_rating_stats", sql=f"""WITH {RAT} SELECT count(*) AS n_ratings, count(DISTINCT user_id) AS n_users,
  count(DISTINCT item_id) AS n_items_rated, (SELECT count(*) FROM part) AS n_items FROM r""")
def rating_stats(spark, sf):
    return M.rating_stats(_ratings(spark, sf, keep=()), _items(spark, sf))


@query("rec_unrated_counts", sql=f"""WITH {RAT}, {ITEMS}, rated AS (SELECT DISTINCT user_id, item_id FROM r)
SELECT user_id, (SELECT count(DISTINCT item_id) FROM items)
       - count(DISTINCT CASE WHEN item_id IN (SELECT item_id FROM items) THEN item_id END) AS n_candidates
FROM rated GROUP BY user_id""")
def unrated_counts(spark, sf):
    return M.unrated_candidate_counts(_ratings(spark, sf, keep=()), _items(spark, sf))


UNRATED = f"""(SELECT DISTINCT {ONE_USER} AS user_id, item_id FROM items
  WHERE item_id NOT IN (SELECT item_id FROM r WHERE user_id = {ONE_USER}))"""


@query("rec_unrated_candidates_user", sql=f"WITH {RAT}, {ITEMS} SELECT user_id, item_id FROM {UNRATED}")
def unrated_candidates_user(spark, sf):
    ratings = _ratings_once(spark, sf)
    return M.unrated_candidates(ratings, _items(spark, sf), _one_user(ratings))


@query("rec_train_als", sql=f"WITH {RAT} SELECT DISTINCT user_id, CAST(10 AS INT) AS rank FROM r")
def train_als(spark, sf):
    m = _model(spark, sf)
    return m.userFactors.select(F.col("id").alias("user_id"), F.size("features").alias("rank"))


@query("rec_score_candidates_user", sql=f"""WITH {RAT}, {ITEMS}
SELECT user_id, item_id, TRUE AS is_product FROM {UNRATED} WHERE item_id IN (SELECT item_id FROM r)""")
def score_candidates_user(spark, sf):
    """Scores of one user's candidates, held against the products of the stored factors, summed in SQL."""
    ratings = _ratings_once(spark, sf)
    model = M.train_als(ratings)
    cands = M.unrated_candidates(ratings, _items(spark, sf), _one_user(ratings))
    path = scratch_path(spark, "factors")
    for side, factors in (("users", model.userFactors), ("items", model.itemFactors)):
        factors.select("id", F.posexplode("features").alias("place", "x")).write.parquet(f"{path}/{side}")
    u, i = (spark.read.parquet(f"{path}/{side}") for side in ("users", "items"))
    users = u.select(F.col("id").alias("user_id"), "place", F.col("x").alias("ux"))
    products = cands.join(users, "user_id").join(i.select(F.col("id").alias("item_id"), "place", "x"), ["item_id", "place"]) \
        .groupBy("user_id", "item_id").agg(F.sum(F.col("ux").cast("double") * F.col("x").cast("double")).alias("product"))
    scores = M.score_candidates(model, cands).join(products, ["user_id", "item_id"], "full_outer")
    near = F.abs(F.col("score") - F.col("product")) <= 1e-4 * (1 + F.abs("product"))
    return scores.select("user_id", "item_id", F.coalesce(near, F.lit(False)).alias("is_product"))


@query("rec_top_items")
def top_items(spark, sf):
    return _top(spark, sf)


@query("rec_top_items_audit", sql=f"""WITH {RAT}, {ITEMS}, {DEPTH}
SELECT user_id, CAST(n AS BIGINT) AS n, CAST(1 AS BIGINT) AS first_rank, CAST(n AS BIGINT) AS last_rank, CAST(n AS BIGINT) AS n_items,
  CAST(0 AS BIGINT) AS n_rated, CAST(0 AS BIGINT) AS n_unknown, CAST(0 AS BIGINT) AS n_out_of_order, CAST(0 AS BIGINT) AS n_stored_differently
FROM depth WHERE n > 0""")
def top_items_audit(spark, sf):
    """Every user's list: length, ranks 1 to n, distinct unrated dictionary items, scores in order, stored scores truncated."""
    ratings, items = _ratings_once(spark, sf), _items(spark, sf)
    top = _top(spark, sf, ratings=ratings)
    w = Window.partitionBy("user_id").orderBy("rank")
    before = F.lag(F.struct(-F.col("score"), F.col("item_id"))).over(w)
    t = top.withColumn("late", (before > F.struct(-F.col("score"), F.col("item_id"))).cast("int"))
    t = t.join(ratings.select("user_id", "item_id").distinct().withColumn("rated", F.lit(1)), ["user_id", "item_id"], "left")
    t = t.join(items.select("item_id").distinct().withColumn("known", F.lit(1)), "item_id", "left")
    stored = M.stored_recommendations(top).withColumnRenamed("score", "kept")
    t = t.join(stored, ["user_id", "item_id"], "left")
    cut = F.when(F.col("score") < 0, F.ceil("score")).otherwise(F.floor("score"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return t.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").cast("long").alias("first_rank"), F.max("rank").cast("long").alias("last_rank"),
        F.count_distinct("item_id").alias("n_items"), count(F.col("rated")).alias("n_rated"), count(F.col("known").isNull()).alias("n_unknown"),
        count(F.col("late")).alias("n_out_of_order"), count(~F.col("kept").eqNullSafe(cut.cast("int"))).alias("n_stored_differently"))


def _listing(spark, sf):
    ratings = _ratings_once(spark, sf, keep=("seq",))
    return M.recommendation_listing(M.upsert_ratings(ratings, "seq"), _top(spark, sf, ratings=ratings), _items(spark, sf))


@query("rec_listing_audit", sql=f"""WITH {RAT}, {ITEMS}, {DEPTH}
SELECT depth.user_id, 'recommended' AS list, CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS n_titles FROM depth WHERE n > 0
UNION ALL SELECT rated.user_id, 'rated', count(*), count(title) FROM rated JOIN depth ON depth.user_id = rated.user_id AND n > 0
  LEFT JOIN items ON items.item_id = rated.item_id GROUP BY rated.user_id""")
def listing_audit(spark, sf):
    rows = _listing(spark, sf)
    return rows.groupBy("user_id", "list").agg(F.count(F.lit(1)).alias("n"), F.count("title").alias("n_titles"))


@query("rec_stored_recommendations")
def stored_recommendations(spark, sf):
    return M.stored_recommendations(_top(spark, sf))


@query("rec_recommendation_listing")
def recommendation_listing(spark, sf):
    return _listing(spark, sf)


@query("rec_rated_titles", sql=f"""WITH {RAT}, {ITEMS}, rated AS (SELECT DISTINCT user_id, item_id FROM r)
SELECT rated.user_id, 'rated' AS list, rated.item_id, items.title FROM rated LEFT JOIN items USING (item_id)""")
def rated_titles(spark, sf):
    return M.rated_titles(_store(spark, sf), _items(spark, sf))


@query("rec_recommend_for_user")
def recommend_for_user(spark, sf):
    ratings = _ratings_once(spark, sf, keep=("seq",))
    store, user = M.upsert_ratings(ratings, "seq"), _one_user(ratings)  # every user of the ratings is in the store
    r = M.recommend_for_user(store, _top(spark, sf, ratings=ratings), _items(spark, sf), user)
    return r.select("user_id", F.array_join("rated", "|").alias("rated"),
                    F.array_join("recommended", "|").alias("recommended"))


@query("rec_recommendation_store", sql=f"""WITH {RAT}, {ITEMS}, {DEPTH}
SELECT user_id, CAST(CASE WHEN user_id % 7 = 0 THEN least(n, 5) ELSE n END AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_other
FROM depth WHERE n > 0 AND user_id % 11 <> 0""")
def recommendation_store(spark, sf):
    """Lists of all users, then shorter ones for some, then none for others: each user's rows are those of the last
    write that was theirs, with the truncated scores."""
    path = scratch_path(spark, "store")
    top, store = _top(spark, sf), M.RecommendationStore(spark, path, buckets=16)
    store.put(top)
    some = top.where("user_id % 7 = 0")
    store.put(some.where("rank <= 5"), some.select("user_id"))
    store.put(top.where("false"), top.where("user_id % 11 = 0").select("user_id"))
    want = M.stored_recommendations(top.where("user_id % 7 <> 0 OR rank <= 5")).withColumnRenamed("score", "want")
    rows = store.all().join(want, ["user_id", "item_id"], "left")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("score").eqNullSafe(F.col("want"))).alias("n_other"))


@query("rec_stored_listing_user", sql=f"""WITH {RAT}, {ITEMS}, {DEPTH}
SELECT user_id, (SELECT string_agg(coalesce(title, '?'), '|' ORDER BY rated.item_id) FROM rated LEFT JOIN items USING (item_id) WHERE rated.user_id = {ONE_USER}) AS rated,
  CAST(n AS BIGINT) AS n_recommended, CAST(n AS BIGINT) AS n_best FROM depth WHERE user_id = {ONE_USER} AND n > 0""")
def stored_listing_user(spark, sf):
    """M11 for one user from the stored tables, one bucket or folder of each; the recommended items are held against a
    ranking of the products of the stored factors."""
    ratings, items = _ratings_once(spark, sf, keep=("seq",)), _items(spark, sf)
    user = _one_user(ratings)
    keyed = write_keyed(M.upsert_ratings(ratings, "seq"), ["user_id", "item_id"], scratch_path(spark, "ratings"), 16)
    model = M.train_als(ratings)
    store = M.RecommendationStore(spark, scratch_path(spark, "store"), buckets=16)
    top = scratch_path(spark, "recommendations")
    M.top_items_per_user(model, ratings, items, 20).write.parquet(top)  # the store reads its input more than once
    store.put(spark.read.parquet(top))
    mine = read_keyed(spark, keyed, user_id=user)
    lists = M.recommend_for_user(mine, store.of_user(user), items, user)
    x = model.userFactors.where(F.col("id") == F.lit(user)).select(F.posexplode("features").alias("place", "ux"))
    y = model.itemFactors.join(items.select(F.col("item_id").alias("id")), "id", "left_semi").join(mine.select(F.col("item_id").alias("id")), "id", "left_anti")
    products = y.select("id", F.posexplode("features").alias("place", "y")).join(F.broadcast(x), "place") \
        .groupBy("id").agg(F.sum(F.col("ux").cast("double") * F.col("y").cast("double")).alias("product"))
    cut = products.orderBy(F.col("product").desc()).limit(20).agg(F.min("product").alias("least"))
    best = store.of_user(user).join(products, F.col("id") == F.col("item_id")).join(F.broadcast(cut), F.col("product") >= F.col("least") - 1e-4)
    n = best.agg(F.count(F.lit(1)).alias("n_best"), F.lit(user).alias("user_id"))
    return lists.join(n, "user_id").select("user_id", F.array_join("rated", "|", "?").alias("rated"), F.size("recommended").cast("long").alias("n_recommended"), "n_best")
