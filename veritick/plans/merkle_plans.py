"""Queries of long chains of links and of whole transparency logs: every event is an entry, in order of its id; every 997th size is a checkpoint, and the last."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritick.functions import scalars as S
from veritick.operators import ledger as L
from veritick.operators import merkle as M
from veritick.operators import proofs as O
from veritick.operators.ordered import positions
from veritick.plans.base import Plans
from veritick.session import cut, table

P = Plans()
STEP = 997
LOG = "events"


def leaves(s, d):
    e = table(s, d, "events").select(F.lit(LOG).alias("log"), "event_id", "user_id", "event_type")
    text = F.concat_ws("|", "event_id", "user_id", "event_type")
    rows = positions(e, "log", "event_id")
    return rows.select("log", "idx", S.leaf_hash(F.encode(text, "utf-8")).alias("leaf_hash"))


def sizes(tiles):
    """Checkpoints from the number of entries alone."""
    n = tiles.where("level = 0").groupBy("log").agg(F.count("*").alias("n"))
    each = F.concat(F.sequence(F.lit(STEP).cast("long"), F.greatest("n", F.lit(STEP)), F.lit(STEP).cast("long")), F.array("n"))
    return n.select("log", F.explode(F.array_distinct(F.filter(each, lambda x: x <= F.col("n")))).alias("tree_size"))


# Levels of each checkpoint's tree by pairing neighbours; a node without a neighbour goes up as it is.
TREES = f"""entries AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, sha256(unhex('00') || encode(concat_ws('|', event_id, user_id, event_type))) AS h FROM events),
total AS (SELECT count(*) AS n FROM entries),
sizes AS (SELECT DISTINCT tree_size FROM (SELECT unnest(range({STEP}, n + 1, {STEP})) AS tree_size FROM total UNION ALL SELECT n FROM total)),
up AS (SELECT tree_size, 0 AS level, idx AS i, h FROM sizes JOIN entries ON idx < tree_size
  UNION ALL SELECT tree_size, level + 1, i // 2, CASE WHEN count(*) = 2 THEN sha256(unhex('01') || unhex(arg_min(h, i)) || unhex(arg_max(h, i))) ELSE any_value(h) END
  FROM up GROUP BY tree_size, level, i // 2 HAVING (tree_size - 1) >> level > 0),
roots AS (SELECT tree_size, h AS root_hex FROM up WHERE (tree_size - 1) >> level = 0)"""


def tiles(s, d):
    return cut(M.tile_table(leaves(s, d)))


def checkpoint_roots(s, d):
    t = tiles(s, d)
    return M.roots(t, sizes(t)).select("tree_size", "root_hex")


P.add("checkpoint_roots", checkpoint_roots, f"WITH RECURSIVE {TREES} SELECT tree_size::BIGINT AS tree_size, root_hex FROM roots")


def log_inclusion(s, d):
    """A proof of every entry in the whole log, replayed against the root; one entry in ten is of other bytes."""
    t = tiles(s, d)
    n = t.where("level = 0").groupBy("log").agg(F.count("*").alias("tree_size"))
    asked = t.where("level = 0").select("log", F.col("i").alias("leaf_index")).join(F.broadcast(n), "log")
    proofs = M.inclusion_proofs(t, asked).join(F.broadcast(M.roots(t, n)), ["log", "tree_size"])
    changed = F.when(F.col("leaf_index") % 10 == 7, S.leaf_hash(F.encode("leaf_hash", "utf-8"))).otherwise(F.col("leaf_hash"))
    return O.audit_inclusion(proofs.withColumn("leaf_hash", changed)).select("leaf_index", F.array_join("path", ",").alias("path"), "problem")


P.add(
    "log_inclusion", log_inclusion,
    f"""WITH RECURSIVE {TREES}, whole AS (SELECT level, i, h FROM up, total WHERE tree_size = n),
    steps AS (SELECT e.idx, w.level, w.h FROM entries e, total, (SELECT unnest(range(0, 62)) AS level) l JOIN whole w ON w.level = l.level AND w.i = xor(e.idx >> l.level, 1) WHERE (n - 1) >> l.level > 0)
    SELECT e.idx AS leaf_index, coalesce(string_agg(s.h, ',' ORDER BY s.level), '') AS path, CASE WHEN e.idx % 10 = 7 THEN 'root' END AS problem FROM entries e LEFT JOIN steps s USING (idx) GROUP BY e.idx""",
)


def log_consistency(s, d):
    """Proofs between neighbouring checkpoints, by the edges of their history, replayed; every third new root is another one."""
    t = tiles(s, d)
    known = cut(M.roots(t, sizes(t)).withColumns({"origin": F.col("log"), "pos": F.col("tree_size")}))
    edges = O.edges(known).select(F.col("origin").alias("log"), F.col("prev_size").alias("first_size"), F.col("next_size").alias("second_size"), F.col("prev_root").alias("first_root"), F.col("next_root").alias("second_root"))
    made = M.consistency_proofs(t, edges).join(edges, ["log", "first_size", "second_size"])
    wrong = F.when(F.floor(F.col("first_size") / STEP) % 3 == 0, F.sha2("second_root", 256)).otherwise(F.col("second_root"))
    return O.audit_consistency(made.withColumn("second_root", wrong)).select("first_size", "second_size", F.array_join("proof", ",").alias("proof"), "problem")


P.add(
    "log_consistency", log_consistency,
    f"""WITH RECURSIVE {TREES}, pairs AS (SELECT * FROM (SELECT lag(tree_size) OVER (ORDER BY tree_size) AS m, tree_size AS n FROM sizes) WHERE m IS NOT NULL),
    starts AS (SELECT *, length(bin(m)) - length(rtrim(bin(m), '0')) AS t FROM pairs),
    needed AS (SELECT m, n, -1 AS level, t AS at, (m >> t) - 1 AS i FROM starts WHERE (m >> t) > 1
      UNION ALL SELECT m, n, l, l, xor(((m >> t) - 1) >> (l - t), 1) FROM (SELECT *, unnest(range(t, 62)) AS l FROM starts) WHERE (n - 1) >> l > 0)
    SELECT m::BIGINT AS first_size, n::BIGINT AS second_size, coalesce(string_agg(u.h, ',' ORDER BY d.level) FILTER (u.h IS NOT NULL), '') AS proof, CASE WHEN m // {STEP} % 3 = 0 THEN 'new-root' END AS problem
    FROM needed d LEFT JOIN up u ON u.tree_size = d.n AND u.level = d.at AND u.i = d.i GROUP BY m, n""",
)


# Long chains: a ledger per type of event, a link per event. Some links have lost their pointer's target, some have a twin
# after the same link.
def long_chains(s, d):
    e = positions(table(s, d, "events").select("event_type", "event_id", "user_id"), "event_type", "event_id")
    sha = lambda k: F.sha2(F.concat_ws("/", "event_type", k), 256)
    prev = F.when(F.col("idx") == 0, None).when(F.col("user_id") % 401 == 77, F.sha2("event_type", 256)).otherwise(sha(F.col("idx") - 1))
    rows = e.select(F.col("event_type").alias("ledger"), "idx", sha(F.col("idx")).alias("sha256"), prev.alias("prev_sha"), "user_id")
    twins = rows.where("user_id % 307 = 5 and idx > 0").withColumn("prev_sha", F.sha2(F.concat_ws("/", "ledger", F.col("idx") - 1), 256)).withColumn("sha256", F.sha2(F.concat_ws("/", "ledger", "idx", F.lit("twin")), 256))
    return rows.unionByName(twins).select("ledger", "idx", "sha256", "prev_sha")


CHAINS = """e AS (SELECT event_type AS ledger, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx, user_id FROM events),
torn AS (SELECT ledger, idx FROM e WHERE idx > 0 AND user_id % 401 = 77),
rows AS (SELECT ledger, idx, sha256(ledger || '/' || idx) AS sha256, (SELECT max(t.idx) FROM torn t WHERE t.ledger = e.ledger AND t.idx <= e.idx) AS torn_at FROM e
  UNION ALL SELECT ledger, idx, sha256(ledger || '/' || idx || '/twin'), (SELECT max(t.idx) FROM torn t WHERE t.ledger = e.ledger AND t.idx < e.idx) FROM e WHERE user_id % 307 = 5 AND idx > 0)"""
P.add(
    "chain_reach", lambda s, d: L.chain_reach(long_chains(s, d)),
    f"WITH {CHAINS} SELECT ledger, sha256, idx - coalesce(torn_at, 0) AS before, CASE WHEN torn_at IS NULL THEN 'genesis' ELSE 'missing' END AS end FROM rows",
)
P.add(
    "chain_shape", lambda s, d: L.chain_shape(long_chains(s, d)),
    f"""WITH {CHAINS}, per AS (SELECT ledger, idx, count(*) AS n FROM rows WHERE torn_at IS NULL GROUP BY ALL), sound AS (SELECT ledger, coalesce(min(CASE WHEN n > 1 THEN idx END), max(idx) + 1) AS sound FROM per GROUP BY ledger)
    SELECT ledger, count(*) AS links, any_value(sound) AS sound, count(*) FILTER (torn_at IS NULL) - any_value(sound) AS beyond, count(*) FILTER (torn_at IS NOT NULL) AS cut_off, 0::BIGINT AS looped FROM rows JOIN sound USING (ledger) GROUP BY ledger""",
)
QUERIES, ORACLE_SQL = P.queries, P.sql
