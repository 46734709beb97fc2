"""The p1..p5 queries over a folder of tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bookweave.operators import anomalies, changes, features, orphans
from bookweave.plans.feed_sql import FEED_SQL
from bookweave.session import table


def p1_orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(*(table(spark, d, n) for n in ("messages", "executions", "fills", "child_orders")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_orphans(spark, d).select("src_table", "trade_day", "rec_id").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p1_orphans(spark, d), table(spark, d, "book_snapshots"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return changes.open_orders(table(spark, d, "messages"))


def p3_features(spark: SparkSession, d: str) -> DataFrame:
    return features.entity_features(table(spark, d, "messages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.implausible(table(spark, d, "messages"), table(spark, d, "ci_history"))


def p5_locates(spark: SparkSession, d: str) -> DataFrame:
    return features.locate_totals(table(spark, d, "messages"), table(spark, d, "executions"))


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table and trade day, direct and inherited together, beside the handler's count."""
    r = p1_report(spark, d)
    return r.select("src_table", "trade_day", (r["direct"] + r["inherited"]).alias("orphans"), "handler_unknown_refs")


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_totals, p2_found, p3_features, p4_found, p5_locates)}

_CODE = (
    "CASE WHEN length(type) = 1 AND ascii(type) < 128 THEN lower(hex(type)) "
    "WHEN regexp_full_match(type, '0x[0-9a-fA-F]{2}') THEN lower(substr(type, 3, 2)) ELSE 'other' END"
)
_COMPACT = f"""
once AS (SELECT trade_day, locate, {_CODE} AS code, seq, max(ts) AS ts, max(shares) AS shares
         FROM messages WHERE seq IS NOT NULL GROUP BY ALL),
long AS (SELECT trade_day, locate, code, count(*) AS n, max(ts) AS last_ts, sum(shares) AS shares FROM once GROUP BY ALL)"""


def _p3_sql() -> str:
    cols = []
    for c in features.TYPE_CODES:
        f = f"FILTER (code = '{c}')"
        cols += [
            f"coalesce(max(n) {f}, 0)::BIGINT AS t{c}_n",
            f"(max(last_ts) {f})::BIGINT AS t{c}_last_ts",
            f"coalesce(max(shares) {f}, 0)::BIGINT AS t{c}_shares",
            f"(max(last_ts) - max(last_ts) {f})::BIGINT AS t{c}_recency",
        ]
    return f"WITH {_COMPACT} SELECT trade_day, locate, {', '.join(cols)} FROM long GROUP BY trade_day, locate"


_P5_SQL = f"""
WITH {_COMPACT},
msg AS (SELECT locate, {', '.join(f"sum(n) FILTER (code = '{ord(t):02x}') AS n_{t}" for t in 'AFECXDU')}, sum(n) AS n_messages,
               sum(shares) FILTER (code IN ('45', '43')) AS executed_shares, max(last_ts) AS last_ts FROM long GROUP BY locate),
tape AS (SELECT trade_day, locate, exec_id, max(shares) AS shares FROM executions WHERE exec_id IS NOT NULL GROUP BY ALL),
seen AS (SELECT DISTINCT trade_day, locate FROM once),
own AS (SELECT s.locate, count(*) AS tape_records, sum(t.shares) AS tape_shares FROM seen s JOIN tape t USING (trade_day, locate) GROUP BY s.locate),
pairs AS (SELECT o.locate, count(*) AS pairs, sum(t.shares) AS pairs_tape_shares FROM once o JOIN tape t ON o.trade_day = t.trade_day AND o.locate = t.locate GROUP BY o.locate)
SELECT m.locate, n_messages::BIGINT AS n_messages, {', '.join(f'coalesce(n_{t}, 0)::BIGINT AS n_{t}' for t in 'AFECXDU')}, coalesce(executed_shares, 0)::BIGINT AS executed_shares,
       last_ts, coalesce(tape_records, 0)::BIGINT AS tape_records, coalesce(tape_shares, 0)::BIGINT AS tape_shares,
       coalesce(pairs, 0)::BIGINT AS pairs, coalesce(pairs_tape_shares, 0)::BIGINT AS pairs_tape_shares
FROM msg m LEFT JOIN own ON m.locate = own.locate LEFT JOIN pairs ON m.locate = pairs.locate
"""

SQL = {
    "p3_features": _p3_sql(),
    "p5_locates": _P5_SQL,
    "p1_totals": f"""WITH found AS ({FEED_SQL["p1_found"]}) SELECT src_table, trade_day, count(*) AS orphans, (SELECT max(unknown_refs) FROM book_snapshots b WHERE b.trade_day = found.trade_day) AS handler_unknown_refs
        FROM found GROUP BY ALL""",
}
