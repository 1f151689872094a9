"""Queries of the split, fold and sample operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetable.functions.hashing import ROUNDS
from wavetable.operators import splits as C
from wavetable.plans.registry import query
from wavetable.schema import in_view
from wavetable.sources import views as V

W_CHUNKS = f"WITH {V.SQL_CHUNKS}"
W_BIG = f"WITH {V.SQL_BIG}"
BIG_ID = "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::date)"


def cut(n: str, test: float | None, val: float, rank: str = "rk") -> str:
    t, v = f"greatest(1, round_even({n}*{test}e0, 0))" if test else "0", f"greatest(1, round_even({n}*{val}e0, 0))"
    return f"CASE WHEN {rank} <= {t} THEN 'test' WHEN {rank} <= {t} + {v} THEN 'val' ELSE 'train' END"


@query(f"{W_CHUNKS}, o AS (SELECT chunk_id, row_number() OVER (ORDER BY md5(concat('0:', chunk_id)), chunk_id) rk, count(*) OVER () n FROM chunks) SELECT chunk_id, {cut('n', 0.15, 0.3)} AS part FROM o")
def split_in_session(spark, sf):
    return C.in_session(V.chunks(spark, sf))


@query(f"{W_CHUNKS}, u AS (SELECT chunk_id, cast(concat('0x', substr(md5(concat('0:', chunk_id)), 1, 8)) as bigint)/4294967296e0 u FROM chunks) SELECT chunk_id, CASE WHEN u < 0.15 THEN 'test' WHEN u < 0.15e0 + 0.3e0 THEN 'val' ELSE 'train' END AS part FROM u")
def split_in_session_by_hash(spark, sf):
    return C.in_session_by_hash(V.chunks(spark, sf))


CROSS = f"{W_CHUNKS}, g AS (SELECT grp, row_number() OVER (ORDER BY md5(concat('0:', grp))) rk, count(*) OVER () n FROM (SELECT DISTINCT grp FROM chunks)), sp AS (SELECT {cut('n', 0.15, 0.3)} AS part, grp FROM g)"
LAB = f"""{W_CHUNKS}, g AS (SELECT grp, row_number() OVER (ORDER BY md5(concat('0:', grp))) rk, count(*) OVER () n FROM (SELECT DISTINCT grp FROM chunks WHERE dataset = 'labA')),
sp AS (SELECT {cut('n', None, 0.3)} AS part, grp FROM g UNION ALL SELECT DISTINCT 'test', grp FROM chunks WHERE dataset = 'labB')"""


@query(f"{CROSS} SELECT part, grp FROM sp")
def split_cross_session(spark, sf):
    return C.cross_session(V.chunks(spark, sf))


@query(f"{LAB} SELECT part, grp FROM sp")
def split_cross_lab(spark, sf):
    return C.cross_lab(V.chunks(spark, sf), ["labA"], ["labB"])


@query(f"{CROSS} SELECT part, count(*) n, count(DISTINCT grp) n_groups FROM sp JOIN chunks USING (grp) GROUP BY 1")
def verify_split(spark, sf):
    index = V.chunks(spark, sf)
    split = C.cross_session(index)
    verified = C.verify(split, index).select("part")
    return C.sizes(split, index).join(verified, "part")


@query(f"""{LAB}, bad AS (SELECT part, grp FROM sp UNION ALL SELECT 'train', 'p108'), k AS (SELECT grp, count(DISTINCT part) k FROM bad GROUP BY 1),
ds AS (SELECT dataset, count(DISTINCT part) k FROM bad JOIN (SELECT DISTINCT grp, dataset FROM chunks) USING (grp) WHERE part IN ('train', 'test') GROUP BY 1)
SELECT 'shared_groups' AS violation, count(*) FILTER (k > 1) n FROM k UNION ALL SELECT 'empty_parts', 3 - count(DISTINCT part) FROM bad UNION ALL SELECT 'shared_datasets', count(*) FILTER (k > 1) FROM ds""")
def leakage_report(spark, sf):
    index = V.chunks(spark, sf)
    leaky = C.cross_lab(index, ["labA"], ["labB"]).unionByName(index.filter("grp = 'p108'").select(F.lit("train").alias("part"), "grp").distinct())
    return C.leakage(leaky, index, "cross_lab")


def sql_loso(dataset: str) -> str:
    return f"""(SELECT 'loso_{dataset}' AS scheme, fold, CASE WHEN fold = grp THEN 'test' WHEN row_number() OVER (PARTITION BY fold ORDER BY fold = grp, md5(concat('0:', fold, ':', grp))) <= greatest(1, round_even((n-1)*0.25e0, 0)) THEN 'val' ELSE 'train' END AS part, grp
FROM (SELECT a.grp fold, b.grp, count(*) OVER (PARTITION BY a.grp) n FROM (SELECT DISTINCT grp FROM chunks WHERE dataset = '{dataset}') a, (SELECT DISTINCT grp FROM chunks WHERE dataset = '{dataset}') b))"""


def sql_lab(source: str, target: str) -> str:
    return f"""(SELECT 'cross_lab_{source}_to_{target}' AS scheme, fold, CASE WHEN rk <= greatest(1, round_even(n*0.25e0, 0)) THEN 'val' ELSE 'train' END AS part, grp FROM
 (SELECT grp, row_number() OVER (ORDER BY md5(concat('0:', grp))) rk, count(*) OVER () n FROM (SELECT DISTINCT grp FROM chunks WHERE dataset = '{source}')), (SELECT DISTINCT grp fold FROM chunks WHERE dataset = '{target}')
UNION ALL SELECT DISTINCT 'cross_lab_{source}_to_{target}', grp, 'test', grp FROM chunks WHERE dataset = '{target}')"""


@query(f"{W_CHUNKS} SELECT * FROM {sql_loso('labA')}")
def loso_folds(spark, sf):
    return C.leave_one_out(V.chunks(spark, sf), "labA")


@query(f"{W_CHUNKS} SELECT * FROM {sql_lab('labA', 'labB')}")
def cross_lab_folds(spark, sf):
    return C.cross_lab_folds(V.chunks(spark, sf), "labA", "labB")


ALL_SCHEMES = f"{W_CHUNKS}, al AS (SELECT * FROM {sql_loso('labA')} UNION ALL SELECT * FROM {sql_loso('labB')} UNION ALL SELECT * FROM {sql_lab('labA', 'labB')} UNION ALL SELECT * FROM {sql_lab('labB', 'labA')})"


@query(f"{ALL_SCHEMES} SELECT * FROM al")
def schemes(spark, sf):
    return C.schemes(V.chunks(spark, sf))


@query(f"{ALL_SCHEMES} SELECT DISTINCT scheme, 'all_target_groups' AS fold, part, grp FROM al WHERE scheme LIKE 'cross_lab%'")
def pooled_fold(spark, sf):
    return C.pooled(C.schemes(V.chunks(spark, sf)))


def sql_rotated(offsets: dict[str, int]) -> str:
    held = " UNION ALL ".join(f"SELECT fold, '{p}' AS part, grp FROM f, g WHERE (fold + {o}) % n = i" for p, o in offsets.items())
    return f"""{W_CHUNKS}, g AS (SELECT dataset, grp, row_number() OVER (PARTITION BY dataset ORDER BY grp) - 1 i, count(*) OVER (PARTITION BY dataset) n FROM (SELECT DISTINCT dataset, grp FROM chunks)),
f AS (SELECT unnest(range(0, (SELECT max(n) FROM g)))::int fold), h AS ({held})
SELECT * FROM h UNION ALL SELECT fold, 'train', grp FROM f, g WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.fold = f.fold AND h.grp = g.grp)"""


@query(sql_rotated({"test": 0}))
def paired_folds(spark, sf):
    return C.paired_holdout(V.chunks(spark, sf))


@query(sql_rotated({"test": 0, "val": 1}))
def rotated_folds(spark, sf):
    return C.rotated(V.chunks(spark, sf))


def _big_id(spark, sf):
    return V.big(spark, sf).withColumn("id", F.concat_ws(":", *[F.col(c).cast("string") for c in V.KEY[:4]], F.to_date("l_shipdate").cast("string"))).select("id", "gid", "channel", "label")


BIG_IDS = f"{W_BIG}, b AS (SELECT {BIG_ID} AS id, gid, channel, label FROM big)"


@query(f"{BIG_IDS} SELECT id, label FROM b QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(concat('0:', id)), id) <= 500")
def balanced_sample(spark, sf):
    return C.balanced_sample(_big_id(spark, sf), 500, ["id"]).select("id", "label")


@query(f"{BIG_IDS} SELECT id, gid, channel FROM b QUALIFY row_number() OVER (PARTITION BY gid, channel ORDER BY md5(concat('0:', id)), id) <= 25")
def channel_sample(spark, sf):
    return C.keyed_sample(_big_id(spark, sf), 25, ["gid", "channel"], ["id"]).select("id", "gid", "channel")


@query(f"{BIG_IDS} SELECT id FROM b ORDER BY md5(concat('0:', id)), id LIMIT 4000")
def capped_sample(spark, sf):
    return C.capped_sample(_big_id(spark, sf), 4000, ["id"]).select("id")


@query(f"{BIG_IDS}, o AS (SELECT id, gid, row_number() OVER (PARTITION BY gid ORDER BY id) k FROM b), s AS (SELECT gid, label, row_number() OVER (PARTITION BY gid ORDER BY md5(concat('0:', id)), id) k FROM b) SELECT id, gid, label FROM o JOIN s USING (gid, k)")
def permuted_labels(spark, sf):
    return C.permuted_labels(_big_id(spark, sf), ["gid"], "id").select("id", "gid", "label")


#: The bijection round by round: x and its partner change places or not.
SQL_SHUFFLE = f"""pl AS (SELECT id, gid, label, row_number() OVER (PARTITION BY gid ORDER BY id) - 1 x, count(*) OVER (PARTITION BY gid) n FROM b),
st AS (SELECT i, gid, draw, id, n, x, s FROM (SELECT 0 i, gid, draw, id, n, x, cast(concat('0x', substr(md5(concat('0:', gid, ':', draw)), 1, 7)) AS bigint) + 1 s FROM pl, range(1, 3) t(draw))
UNION ALL SELECT i + 1, gid, draw, id, n, CASE WHEN ((t * t % 2147483647) * t + a) % 2147483647 % 2 = 1 THEN o ELSE x END, c FROM (
SELECT *, (greatest(x, o) % 2147483647 + c) % 2147483647 t FROM (SELECT *, (((a * 2147483648 + b) % n - x) % n + n) % n o FROM (
SELECT *, b * 48271 % 2147483647 c FROM (SELECT *, a * 48271 % 2147483647 b FROM (SELECT *, s * 48271 % 2147483647 a FROM st WHERE i < {ROUNDS}))))))"""


@query(f"{BIG_IDS.replace('WITH', 'WITH RECURSIVE', 1)}, {SQL_SHUFFLE} SELECT st.id, st.gid, draw::int draw, pl.label FROM st JOIN pl ON pl.gid = st.gid AND pl.x = st.x WHERE i = {ROUNDS}")
def permuted_draws(spark, sf):
    """Two draws of labels, dealt anew inside each group."""
    return C.permuted_draws(_big_id(spark, sf), ["gid"], "id", [1, 2]).select("id", "gid", "draw", "label")


@query(f"{W_BIG} SELECT i::int AS label, coalesce(n, 0) n FROM range(0, 5) t(i) LEFT JOIN (SELECT label, count(*) n FROM big WHERE label IN (0, 2, 3, 4) GROUP BY 1) ON label = i")
def class_counts(spark, sf):
    return C.class_counts(in_view(V.big(spark, sf), "4class"))


