"""Queries over splits, folds, class balancing and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import balance
from ..operators.neighbours import nearest
from .registry import HASH, query


def h(key: str, salt: str = "") -> str:
    text = f"{key}::VARCHAR" + (f"||'{salt}'" if salt else "")
    return HASH % text


RANKED = "(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {h}, {id}) - 1 AS place, count(*) OVER (PARTITION BY {by}) n FROM {t})"


def ranked(t: str, by: str, key: str, salt: str = "") -> str:
    return RANKED.format(t=t, by=by, id=key, h=h(key, salt))


@query("random_split", "M13", f"SELECT o_orderkey, {h('o_orderkey')} % 100 < 20 AS is_test FROM orders")
def _(spark, sf):
    return views.table(spark, sf, "orders").select("o_orderkey", balance.is_test_row(F.col("o_orderkey")).alias("is_test"))


@query("stratified_split", "M14", f"""
SELECT o_orderkey, o_orderstatus, place < floor(n * 0.2::DOUBLE + 0.5) is_test FROM {ranked('orders', 'o_orderstatus', 'o_orderkey')}""")
def _(spark, sf):
    df = views.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return balance.stratified_split(df, "o_orderkey", "o_orderstatus")


@query("stratified_folds", "T10", f"""
SELECT o_orderkey, o_orderstatus, {' + '.join(f'(place >= floor(n * {i} / 5::DOUBLE))::INT' for i in range(1, 5))} fold
FROM {ranked('orders', 'o_orderstatus', 'o_orderkey', 'fold')}""")
def _(spark, sf):
    df = views.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return balance.stratified_folds(df, "o_orderkey", "o_orderstatus")


@query("random_oversampling", "M17", f"""
SELECT vec_id, label, unnest(range((need // n + (place < need % n)::INT + 1)::BIGINT)) AS copy FROM
 (SELECT *, (SELECT max(c) FROM (SELECT count(*) c FROM embeddings GROUP BY label)) - n need FROM {ranked('embeddings', 'label', 'vec_id', 'over')})""")
def _(spark, sf):
    return balance.random_oversample(views.embeddings(spark, sf).select("vec_id", "label"), "vec_id", "label")


SIZES = "(SELECT o_orderstatus s, count(*) c FROM orders GROUP BY 1)"


@query("random_undersampling", "M18", f"""
SELECT o_orderkey, o_orderstatus FROM {ranked('orders', 'o_orderstatus', 'o_orderkey', 'under')}
WHERE o_orderstatus <> (SELECT s FROM {SIZES} ORDER BY c DESC, s LIMIT 1) OR place < (SELECT min(c) FROM {SIZES})""")
def _(spark, sf):
    df = views.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return balance.random_undersample(df, "o_orderkey", "o_orderstatus")


DISTANCE = "round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))), 9)"
NEAR = f"""SELECT a.vec_id AS id, a.label, b.vec_id neighbour, {DISTANCE} distance, b.embedding other,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {DISTANCE}, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id"""


@query("nearest_neighbours", "J11", f"SELECT id, label, rank, neighbour, distance FROM ({NEAR}) WHERE rank <= 5")
def _(spark, sf):
    near = nearest(views.embeddings(spark, sf), 5, "vec_id", "embedding", "label")
    return near.select("id", "label", "rank", "neighbour", F.round("distance", 9).alias("distance"))


K = "least(5, (SELECT min(c) FROM (SELECT count(*) c FROM embeddings GROUP BY label)) - 1)"


def smote_sql(only: str = "TRUE") -> str:
    draw = "id||'-'||copy"
    return f"""WITH near AS ({NEAR}),
  drawn AS (SELECT vec_id id, label, embedding, unnest(range(1, (need // n + (place < need % n)::INT + 1)::BIGINT)) AS copy FROM
    (SELECT *, (SELECT max(c) FROM (SELECT count(*) c FROM embeddings GROUP BY label)) - n need FROM {ranked('embeddings', 'label', 'vec_id', 'smote')}) WHERE {only}),
  picked AS (SELECT *, {h(f'({draw})', 'neighbour')} % {K} + 1 AS pick, {h(f'({draw})', 'gap')} / 4294967296::DOUBLE gap FROM drawn)
  SELECT NULL::BIGINT id, p.label, list_transform(list_zip(p.embedding, n.other), lambda q: q[1]::DOUBLE + gap * (q[2]::DOUBLE - q[1]::DOUBLE)) vec,
    p.id base_id, n.neighbour neighbour_id, p.copy FROM picked p JOIN near n ON n.id = p.id AND n.rank = p.pick
  UNION ALL SELECT vec_id, label, embedding::DOUBLE[], NULL, NULL, NULL FROM embeddings"""


@query("interpolated_oversampling", "M15 J11", f"SELECT id, label, base_id, neighbour_id, copy, round(list_sum(vec), 5) total, round(vec[1], 6) first, round(vec[64], 6) last FROM ({smote_sql()})")
def _(spark, sf):
    made = balance.smote(views.embeddings(spark, sf), "vec_id", "label", "embedding")
    return summarised(made)


def summarised(made):
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return made.select("id", "label", "base_id", "neighbour_id", "copy", F.round(total, 5).alias("total"),
                       F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.round(F.get("vec", F.lit(63)), 6).alias("last"))


SMALLEST = "label = (SELECT label FROM (SELECT label, count(*) c FROM embeddings GROUP BY 1) ORDER BY c, label LIMIT 1)"


@query("smallest_class_oversampling", "M16", f"SELECT id, label, base_id, neighbour_id, copy, round(list_sum(vec), 5) total, round(vec[1], 6) first, round(vec[64], 6) last FROM ({smote_sql(SMALLEST)})")
def _(spark, sf):
    return summarised(balance.smote(views.embeddings(spark, sf), "vec_id", "label", "embedding", minority_only=True))


UNDER = HASH % "(key||'under')"


@query("over_then_under", "M19", f"""
WITH grown AS (SELECT *, coalesce(id::VARCHAR, base_id||'-'||copy) AS key FROM ({smote_sql(SMALLEST)})),
sizes AS (SELECT label, count(*) n FROM grown GROUP BY label),
placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {UNDER}, key) - 1 AS place FROM grown)
SELECT id, label, base_id, neighbour_id, copy, round(list_sum(vec), 5) total, round(vec[1], 6) first, round(vec[64], 6) last FROM placed
WHERE label <> (SELECT label FROM sizes ORDER BY n DESC, label LIMIT 1) OR place < (SELECT min(n) FROM sizes)""")
def _(spark, sf):
    return summarised(balance.over_then_under(views.embeddings(spark, sf), "vec_id", "label", "embedding"))
