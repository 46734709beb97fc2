"""Execution, statistics, session and wire queries, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.functions import wire
from bookweave.functions.running import once
from bookweave.operators import execution as ex
from bookweave.operators import ladder
from bookweave.operators import session_layer as sl
from bookweave.operators import stats
from bookweave.session import table

KEY = ["trade_day", "locate"]
BPS = 1000
RISK = dict(max_shares=2000, max_notional=2_000_000_000, collar_bps=500, cum_shares=6000, cum_notional=10_000_000_000)
AC = dict(risk_aversion=1e-6, volatility=1e-10, impact=1.0)


def children(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "child_orders").where("ts IS NOT NULL"), "child_id")


def prints(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "executions").where("exec_id IS NOT NULL AND ts IS NOT NULL AND price > 0 AND shares > 0")
    return p.groupBy("exec_id").agg(*[F.min(c).alias(c) for c in (*KEY, "ts", "price", "shares")]).withColumnRenamed("exec_id", "print_id")


def quotes(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "book_snapshots").where("published_at IS NOT NULL")
    ns = F.expr("unix_micros(cast(published_at AS timestamp)) % 86400000000 * 1000")
    return q.select(*KEY, ns.alias("ts"), "version", "bid_price", "ask_price").distinct()


def all_parents(s: SparkSession, d: str) -> DataFrame:
    p = children(s, d).groupBy(*KEY).agg(F.sum("shares").alias("total"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    return p.withColumn("bin_ns", F.expr("(end_ts - start_ts) div 7 + 1"))


def parents(s: SparkSession, d: str) -> DataFrame:
    return ex.accepted_parents(all_parents(s, d))


def parent_errors(s, d):
    return ex.rejected_parents(all_parents(s, d)).select(*KEY, "error")


def twap_schedule(s, d):
    return ex.twap_schedule(parents(s, d)).select(*KEY, "bin", "due_ts", "shares")


def twap_children(s, d):
    return ex.released(twap_schedule(s, d), prints(s, d), KEY).select(*KEY, "bin", "due_ts", "shares", "child_ts")


def volume_curve(s, d):
    return s.createDataFrame([(i, c, c - ([0] + ex.VOLUME_CURVE)[i]) for i, c in enumerate(ex.VOLUME_CURVE)], "bucket bigint, cumulative bigint, weight bigint")


def vwap_children(s, d):
    v = ex.vwap_children(parents(s, d), prints(s, d), KEY)
    return ex.first_children(v, KEY, ["ts", "print_id"]).select(*KEY, "ts", "print_id", "child_shares")


def vwap_market_volume(s, d):
    return ex.vwap_children(parents(s, d), prints(s, d), KEY).groupBy(*KEY).agg(F.max("market_shares").alias("market_shares"), F.max("sent").alias("sent"))


def pov_children(s, d):
    v = ex.pov_children(parents(s, d), prints(s, d), KEY, BPS)
    return ex.first_children(v, KEY, ["ts", "print_id"]).select(*KEY, "ts", "print_id", "child_shares")


def almgren_schedule(s, d):
    return ex.almgren_schedule(parents(s, d), **AC).select(*KEY, "bin", "due_ts", "shares")


def _fills(s, d):
    return ex.fills(children(s, d), quotes(s, d), prints(s, d), KEY)


def fills_limit(s, d):
    return _fills(s, d).where("type = 'Limit'").select("child_id", "ts", "side", "price", "bid_price", "ask_price", "fill_price")


def fills_market(s, d):
    return _fills(s, d).where("type = 'Market'").select("child_id", "ts", "last_price", "fill_price")


def fill_stats(s, d):
    return ex.fill_stats(_fills(s, d), ["strategy", "type"])


def risk_reasons(s, d):
    p = prints(s, d).select(*KEY, "ts", "print_id", F.col("price").alias("reference_price"))
    c = ex.as_of(children(s, d), p, KEY, "ts", ["reference_price"], "print_id", ex.BLOCK)
    return ex.risk_gate(c, KEY, ["ts", "child_id"], **RISK).select("child_id", *KEY, "reason")


NOON = 43_200_000_000_000


def risk_reset(s, d):
    """The gate, opened again at noon."""
    p = prints(s, d).select(*KEY, "ts", "print_id", F.col("price").alias("reference_price"))
    c = ex.as_of(children(s, d), p, KEY, "ts", ["reference_price"], "print_id", ex.BLOCK)
    noon = children(s, d).select(*KEY).distinct().withColumn("ts", F.lit(NOON))
    return ex.risk_gate(c, KEY, ["ts", "child_id"], **RISK, resets=noon).select("child_id", *KEY, "reason")


def risk_accepted(s, d):
    return risk_reasons(s, d).groupBy("reason").agg(F.count("*").alias("orders"))


def ci(s, d):
    return table(s, d, "ci_history")


def latency_percentiles(s, d):
    return stats.latency_percentiles(ci(s, d))


def throughput_median_best(s, d):
    return stats.throughput(ci(s, d))


def ratio_gate(s, d):
    return stats.ratio_gate(ci(s, d))


def drift_warning(s, d):
    return stats.drift_warning(ci(s, d))


def history_record_anti(s, d):
    day = F.lit("2024-01-25").cast("timestamp_ntz")
    h = ci(s, d).where(F.col("timestamp_utc").cast("timestamp_ntz") < day)
    return stats.new_rows(ci(s, d), h, ["run_id"]).select("run_id", "commit_sha", "os", "book_type", "message_type", "p99_ns")


def ci_ratio_per_commit(s, d):
    return stats.ratio_per_commit(ci(s, d))


def plot_pivot(s, d):
    return stats.pivot_types(ci(s, d))


def messages(s, d):
    return table(s, d, "messages")


def message_counts(s, d):
    """Frames by counted type: a decoded F counts as A, an undecoded frame under its own type byte."""
    t = F.when(F.col("decoded") & (F.col("type") == "F"), "A").otherwise(F.col("type"))
    once = messages(s, d).groupBy("trade_day", "seq").agg(F.max_by("type", F.col("decoded").cast("int")).alias("type"), F.max("decoded").alias("decoded"))
    return once.groupBy("trade_day", t.alias("type")).agg(F.count("*").alias("frames"))


def ladder_offgrid_rejects(s, d):
    """Adds that only the tick ladder rejects for their price: off the grid of 100."""
    m = messages(s, d).where("decoded AND type IN ('A', 'F', 'U') AND price % 100 <> 0")
    return m.select("trade_day", "seq", "type").distinct().groupBy("trade_day", "type").agg(F.count("*").alias("rejects"))


def ladder_rejects(s, d):
    """Adds and replaces that the tick ladder refuses for their price, off the grid or beyond its window."""
    m = messages(s, d)
    kinds = m.where("decoded AND type IN ('A', 'F', 'U')").select("trade_day", "locate", "seq", "type").distinct()
    return kinds.join(ladder.refused(m), ["trade_day", "locate", "seq"], "left_semi").groupBy("trade_day", "type").agg(F.count("*").alias("rejects"))


def session_dedupe(s, d):
    return sl.dedupe(messages(s, d))


def session_gaps(s, d):
    return sl.gaps(messages(s, d))


def session_gaps_decoded(s, d):
    """Runs of frames that never came whole: a cut copy does not close a gap."""
    return sl.gaps(messages(s, d).where("decoded"))


def session_drain(s, d):
    return sl.drain(messages(s, d))


def retransmit_range_join(s, d):
    m = messages(s, d)
    return sl.retransmitted(sl.gaps(m.where("line = 'A'")).select("trade_day", "first", "count"), m.where("line <> 'A'"))


def snapshot_versions(s, d):
    b = table(s, d, "book_snapshots").distinct()
    return b.groupBy("trade_day", "version").agg(F.count("*").alias("books"), F.max("unknown_refs").alias("unknown_refs"), F.sum("open_orders").alias("open_orders"))


def handler_books(s, d, whole_days=True):
    """What the handler last published of each trade day, in the form the service answers from."""
    b = table(s, d, "book_snapshots").distinct()
    last = b.groupBy("trade_day").agg(F.max("version").alias("version"))
    if not whole_days:
        last = last.agg(F.max(F.struct("trade_day", "version")).alias("x")).select("x.*")
    has = {f"{x}_{c}": F.when(F.col(f"has_{x}"), F.col(f"{x}_{c}")) for x in ("bid", "ask") for c in ("price", "shares")}
    return b.join(F.broadcast(last), ["trade_day", "version"]).withColumns(has).withColumnRenamed("version", "snapshot_version")


def list_json(s, d):
    return wire.list_json(handler_books(s, d), ["trade_day"])


REQUESTS = [
    '{"cmd":"list"}', '{"cmd":"quote","locate":6793}', '{"cmd" : "quote", "locate" :\t65537}', '{"cmd":"quote"}', '{"cmd":"fly"}', "hello", '{"locate":1}', '{"cmd":5,"cmd":"quote","locate":1}',
    '{"cmd":"quote","locate":99999999999999999999999}', '{"cmd":"quote","locate":"7"}',
]


def query_errors(s, d):
    """What the service answers to good and bad lines from the last snapshot of the last day."""
    return wire.answer(s.createDataFrame([(x,) for x in REQUESTS], "line string"), handler_books(s, d, False)).select("line", "response")


# Two connections: line ends of both kinds, empty lines, and a last line that never ended.
TEXTS = [(1, '{"cmd":"quote"}\r\n\r\n\n{"cmd":"fly"}\nhello\n{"cmd":"list"}'), (2, '{"cmd":"quote","locate":3}\n' + "x" * 65537)]


def query_lines(s, d):
    """Requests and line errors in what connections sent."""
    r = wire.request_lines(s.createDataFrame(TEXTS, "connection int, text string"), ["connection"])
    return r.select("connection", "n", F.when(F.col("error").isNull(), F.col("line")).alias("line"), "error")


def wire_encode(s, d):
    m = messages(s, d).where("decoded AND type IN ('A', 'F', 'E', 'C', 'X', 'D', 'U')").withColumn("stock", F.rtrim("stock"))
    m = m.select("trade_day", "seq", "type", "locate", "ts", "ref", "new_ref", "side", "shares", "price", "match", "printable", "stock").distinct()
    return m.select("trade_day", "seq", F.lower(F.hex(wire.frame(wire.encode()))).alias("frame"))


def wire_roundtrip(s, d):
    """Messages by type, and how many come back changed from encoding and decoding (expected 0)."""
    cols = ["locate", "ts", "ref", "new_ref", "shares", "price", "match", "printable", "stock", "side"]
    m = messages(s, d).where("decoded AND type IN ('A', 'F', 'E', 'C', 'X', 'D', 'U')").withColumn("stock", F.rtrim("stock")).withColumn("payload", wire.encode())
    back = wire.decode(m.select("type", F.struct(*cols).alias("was"), "payload"))
    bad = ~F.col("decoded")
    for c in cols:
        x = F.rpad(F.coalesce(F.col(f"was.{c}"), F.lit("")), 1, " ") if c == "side" else F.col(f"was.{c}")
        bad = bad | F.when(F.col(f"was.{c}").isNotNull(), ~F.col(c).eqNullSafe(x)).otherwise(False)
    return back.groupBy("type").agg(F.count("*").alias("messages"), F.count(F.when(bad, 1)).alias("changed"))


_ALL = (
    twap_schedule, twap_children, volume_curve, vwap_children, vwap_market_volume, pov_children, almgren_schedule, fills_limit, fills_market, fill_stats, risk_reasons, risk_reset, parent_errors, risk_accepted,
    latency_percentiles, throughput_median_best, ratio_gate, drift_warning, history_record_anti, ci_ratio_per_commit, plot_pivot, message_counts, ladder_offgrid_rejects, ladder_rejects,
    session_dedupe, session_gaps, session_gaps_decoded, session_drain, retransmit_range_join, snapshot_versions, list_json, query_errors, query_lines, wire_encode, wire_roundtrip,
)
QUERIES = {f.__name__: f for f in _ALL}

_CH = "ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY child_id) AS r_ FROM child_orders WHERE child_id IS NOT NULL AND ts IS NOT NULL) WHERE r_ = 1)"
_PR = """pr AS (SELECT exec_id AS print_id, min(trade_day) AS trade_day, min(locate) AS locate, min(ts) AS ts, min(price) AS price, min(shares) AS shares FROM executions
  WHERE exec_id IS NOT NULL AND ts IS NOT NULL AND price > 0 AND shares > 0 GROUP BY exec_id)"""
_QU = "qu AS (SELECT DISTINCT trade_day, locate, epoch_us(published_at) % 86400000000 * 1000 AS ts, version, bid_price, ask_price FROM book_snapshots)"
_PA = f"""{_CH}, pa AS (SELECT *, (end_ts - start_ts) // 7 + 1 AS bin_ns FROM (SELECT trade_day, locate, sum(shares)::BIGINT AS total, min(ts) AS start_ts, max(ts) AS end_ts FROM ch GROUP BY ALL) WHERE start_ts < end_ts)"""
_TW = f"""{_PA}, bn AS (SELECT *, (end_ts - start_ts + bin_ns - 1) // bin_ns AS bins FROM pa), tw AS (SELECT trade_day, locate, bin, start_ts + (bin + 1) * bin_ns AS due_ts,
  total // bins + CASE WHEN bin < total % bins THEN 1 ELSE 0 END AS shares FROM (SELECT *, unnest(range(0, bins)) AS bin FROM bn))"""
_CUM = "[0, " + ", ".join(map(str, ex.VOLUME_CURVE)) + "]"
_VW = f"""{_PA}, {_PR}, t0 AS (SELECT pr.*, total, (pr.ts - start_ts)::HUGEINT AS el, (end_ts - start_ts)::HUGEINT AS sp FROM pr JOIN pa USING (trade_day, locate) WHERE pr.ts BETWEEN start_ts AND end_ts),
  t1 AS (SELECT *, (CASE WHEN el >= sp THEN 12 ELSE (el * 13) // sp END)::BIGINT AS ix, CASE WHEN el >= sp THEN sp ELSE (el * 13) % sp END AS rem FROM t0),
  t2 AS (SELECT *, least(total, total::HUGEINT * ({_CUM}[ix + 1] + (({_CUM}[ix + 2] - {_CUM}[ix + 1])::HUGEINT * rem) // sp) // 1000000) AS target FROM t1),
  t3 AS (SELECT *, max(target) OVER w AS sent, sum(shares) OVER w AS market_shares FROM t2 WINDOW w AS (PARTITION BY trade_day, locate ORDER BY ts, print_id ROWS UNBOUNDED PRECEDING)),
  t4 AS (SELECT *, sent - coalesce(lag(sent) OVER (PARTITION BY trade_day, locate ORDER BY ts, print_id), 0) AS child_shares FROM t3)"""
_512 = "SELECT trade_day, locate, ts, print_id, child_shares::BIGINT AS child_shares FROM (SELECT *, row_number() OVER (PARTITION BY trade_day, locate ORDER BY ts, print_id) AS slot FROM {} WHERE child_shares > 0) WHERE slot <= 512"
_FI = f"""{_CH}, {_PR}, {_QU},
  lq AS (SELECT ch.*, q.bid_price, q.ask_price FROM ch LEFT JOIN LATERAL (SELECT bid_price, ask_price FROM qu WHERE qu.trade_day = ch.trade_day AND qu.locate = ch.locate AND qu.ts <= ch.ts ORDER BY qu.ts DESC, version DESC LIMIT 1) q ON true),
  lf AS (SELECT lq.*, p.price AS last_price FROM lq LEFT JOIN LATERAL (SELECT price FROM pr WHERE pr.trade_day = lq.trade_day AND pr.locate = lq.locate AND pr.ts <= lq.ts ORDER BY pr.ts DESC, print_id DESC LIMIT 1) p ON true),
  fl AS (SELECT *, CASE WHEN type = 'Limit' THEN CASE WHEN side = 'B' AND price >= ask_price THEN ask_price WHEN side <> 'B' AND price <= bid_price THEN bid_price END ELSE last_price END AS fill_price FROM lf)"""
_RI = f"""{_CH}, {_PR}, rp AS (SELECT ch.*, p.price AS rf FROM ch LEFT JOIN LATERAL (SELECT price FROM pr WHERE pr.trade_day = ch.trade_day AND pr.locate = ch.locate AND pr.ts <= ch.ts ORDER BY pr.ts DESC, print_id DESC LIMIT 1) p ON true),
  ow AS (SELECT *, CASE WHEN shares > {RISK['max_shares']} THEN 'OrderTooLarge' WHEN price::HUGEINT * shares > {RISK['max_notional']} THEN 'NotionalTooLarge' WHEN type = 'Limit' AND rf IS NOT NULL AND abs(price - rf) > rf * {RISK['collar_bps']} // 10000 THEN 'PriceOutOfCollar' END AS own FROM rp),
  cu AS (SELECT *, sum(CASE WHEN own IS NULL THEN shares ELSE 0 END) OVER w AS cs, sum(CASE WHEN own IS NULL THEN price::HUGEINT * shares ELSE 0 END) OVER w AS cn FROM ow WINDOW w AS (PARTITION BY trade_day, locate ORDER BY ts, child_id ROWS UNBOUNDED PRECEDING)),
  tr AS (SELECT *, sum(CASE WHEN own IS NULL AND (cs > {RISK['cum_shares']} OR cn > {RISK['cum_notional']}) THEN 1 ELSE 0 END) OVER (PARTITION BY trade_day, locate ORDER BY ts, child_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cu),
  re AS (SELECT child_id, trade_day, locate, CASE WHEN before > 0 THEN 'KillSwitchTripped' WHEN own IS NOT NULL THEN own WHEN cs > {RISK['cum_shares']} THEN 'CumulativeSharesExceeded' WHEN cn > {RISK['cum_notional']} THEN 'CumulativeNotionalExceeded' ELSE 'None' END AS reason FROM tr)"""
_RUN = "ru AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id) AS r_ FROM ci_history WHERE run_id IS NOT NULL) WHERE r_ = 1)"
_PAIR = f"""{_RUN}, pp AS (SELECT a.commit_sha, a.os, a.runner, a.message_type, a.p50_ns AS ladder_p50, b.p50_ns AS order_p50, a.p50_ns / nullif(b.p50_ns, 0) AS ratio FROM ru a JOIN ru b ON a.commit_sha = b.commit_sha AND a.os = b.os AND a.runner = b.runner
  AND a.message_type = b.message_type AND a.timestamp_utc = b.timestamp_utc WHERE a.book_type = 'LadderBook' AND b.book_type = 'OrderBook')"""
_GAP = "g0 AS (SELECT trade_day, seq, lead(seq) OVER (PARTITION BY trade_day ORDER BY seq) AS nx FROM (SELECT DISTINCT trade_day, seq FROM messages {})), ga AS (SELECT trade_day, seq + 1 AS first, nx - seq - 1 AS count, ceil((nx - seq - 1) / 65534)::BIGINT AS requests FROM g0 WHERE nx > seq + 1)"


_QUOTE = """'"locate":' || locate || ',"best_bid":' || CASE WHEN has_bid THEN bid_price::VARCHAR ELSE 'null' END || ',"best_bid_shares":' || CASE WHEN has_bid THEN bid_shares::VARCHAR ELSE 'null' END || ',"best_ask":' || CASE WHEN has_ask THEN ask_price::VARCHAR ELSE 'null' END
  || ',"best_ask_shares":' || CASE WHEN has_ask THEN ask_shares::VARCHAR ELSE 'null' END || ',"open_orders":' || open_orders || ',"bid_levels":' || bid_levels || ',"ask_levels":' || ask_levels"""
_LIST = f"""'{{"snapshot_version":' || max(version) || ',"unknown_refs":' || max(unknown_refs) || ',"books":[' || string_agg('{{' || {_QUOTE} || '}}', ',' ORDER BY locate) || ']}}'"""
_HB = "hb AS (SELECT DISTINCT * FROM book_snapshots b WHERE version = (SELECT max(version) FROM book_snapshots c WHERE c.trade_day = b.trade_day))"


def _hex(c: str, n: int) -> str:
    return f"right(lpad(lower(to_hex({c}::BIGINT)), 16, '0'), {2 * n})"


_ADD = f"{_hex('ref', 8)} || lower(hex(rpad(coalesce(side, ''), 1, ' '))) || {_hex('shares', 4)} || lower(hex(rpad(rtrim(stock), 8, ' '))) || {_hex('price', 4)}"
_EXE = f"{_hex('ref', 8)} || {_hex('shares', 4)} || {_hex('match', 8)}"
_BODY = f"""CASE type WHEN 'A' THEN {_ADD} WHEN 'F' THEN {_ADD} || '20202020' WHEN 'E' THEN {_EXE} WHEN 'C' THEN {_EXE} || CASE WHEN printable THEN '59' ELSE '4e' END || {_hex('price', 4)}
  WHEN 'X' THEN {_hex('ref', 8)} || {_hex('shares', 4)} WHEN 'D' THEN {_hex('ref', 8)} WHEN 'U' THEN {_hex('ref', 8)} || {_hex('new_ref', 8)} || {_hex('shares', 4)} || {_hex('price', 4)} END"""

SQL = {
    "twap_schedule": f"WITH {_TW} SELECT trade_day, locate, bin, due_ts, shares FROM tw",
    "twap_children": f"WITH {_TW}, {_PR} SELECT tw.*, (SELECT min(pr.ts) FROM pr WHERE pr.trade_day = tw.trade_day AND pr.locate = tw.locate AND pr.ts >= due_ts) AS child_ts FROM tw WHERE child_ts IS NOT NULL",
    "volume_curve": f"SELECT i::BIGINT AS bucket, {_CUM}[i + 2]::BIGINT AS cumulative, ({_CUM}[i + 2] - {_CUM}[i + 1])::BIGINT AS weight FROM range(0, 13) t(i)",
    "vwap_children": f"WITH {_VW} {_512.format('t4')}",
    "vwap_market_volume": f"WITH {_VW} SELECT trade_day, locate, max(market_shares)::BIGINT AS market_shares, max(sent)::BIGINT AS sent FROM t3 GROUP BY ALL",
    "pov_children": f"""WITH {_PA}, {_PR}, t0 AS (SELECT pr.*, total, sum(pr.shares * {BPS} // 10000) OVER (PARTITION BY trade_day, locate ORDER BY pr.ts, print_id ROWS UNBOUNDED PRECEDING) AS cum FROM pr JOIN pa USING (trade_day, locate) WHERE pr.ts <= end_ts),
        t4 AS (SELECT *, least(total, cum) - coalesce(lag(least(total, cum)) OVER (PARTITION BY trade_day, locate ORDER BY ts, print_id), 0) AS child_shares FROM t0) {_512.format('t4')}""",
    "almgren_schedule": f"""WITH {_PA}, bn AS (SELECT *, (end_ts - start_ts + bin_ns - 1) // bin_ns AS bins FROM pa), kt AS (SELECT *, least(50.0, acosh(1.0 + ({AC['risk_aversion']} * {AC['volatility']} * {AC['volatility']} * bin_ns::DOUBLE * bin_ns) / (2.0 * {AC['impact']})) * bins) AS kt FROM bn),
        x AS (SELECT *, CASE WHEN kt < 1e-6 THEN total::DOUBLE / bins ELSE total * (sinh(kt * (bins - bin) / bins) - sinh(kt * (bins - bin - 1) / bins)) / sinh(kt) END AS w FROM (SELECT *, unnest(range(0, bins)) AS bin FROM kt)),
        r AS (SELECT *, round(w)::BIGINT AS s FROM x)
        SELECT trade_day, locate, bin, start_ts + (bin + 1) * bin_ns AS due_ts, (CASE WHEN bin = bins - 1 THEN greatest(0, s + total - sum(s) OVER (PARTITION BY trade_day, locate)) ELSE s END)::BIGINT AS shares FROM r""",
    "fills_limit": f"WITH {_FI} SELECT child_id, ts, side, price, bid_price, ask_price, fill_price FROM fl WHERE type = 'Limit'",
    "fills_market": f"WITH {_FI} SELECT child_id, ts, last_price, fill_price FROM fl WHERE type = 'Market'",
    "fill_stats": f"""WITH {_FI}, st AS (SELECT strategy, type, sum(shares)::BIGINT AS attempted, coalesce(sum(shares) FILTER (fill_price IS NOT NULL), 0)::BIGINT AS filled, sum(shares::HUGEINT * fill_price) AS n FROM fl GROUP BY ALL)
        SELECT strategy, type, attempted, filled, round(CASE WHEN attempted > 0 THEN filled / attempted ELSE 0 END, 6)::DOUBLE AS fill_rate, round(CASE WHEN filled > 0 THEN n::DOUBLE / filled ELSE 0 END, 6)::DOUBLE AS vwap_price FROM st""",
    "risk_reasons": f"WITH {_RI} SELECT * FROM re",
    "risk_reset": "WITH " + _RI.replace("PARTITION BY trade_day, locate ORDER", f"PARTITION BY trade_day, locate, ts >= {NOON} ORDER") + " SELECT * FROM re",
    "parent_errors": f"WITH {_CH} SELECT trade_day, locate, 'start_ts must be before end_ts' AS error FROM ch GROUP BY ALL HAVING min(ts) >= max(ts)",
    "risk_accepted": f"WITH {_RI} SELECT reason, count(*) AS orders FROM re GROUP BY ALL",
    "latency_percentiles": f"""WITH {_RUN}, rk AS (SELECT *, row_number() OVER (PARTITION BY book_type, message_type ORDER BY p99_ns) - 1 AS k, count(*) OVER (PARTITION BY book_type, message_type) AS n FROM ru WHERE p99_ns IS NOT NULL)
        SELECT book_type, message_type, max(n) AS n, max(p99_ns) FILTER (k = floor(0.5 * (n - 1))) AS p50, max(p99_ns) FILTER (k = floor(0.99 * (n - 1))) AS p99, max(p99_ns) FILTER (k = floor(0.999 * (n - 1))) AS p999 FROM rk GROUP BY ALL""",
    "throughput_median_best": f"WITH {_RUN} SELECT runner, book_type, round(median(1e9 / p50_ns), 3) AS median_rate, round(max(1e9 / p50_ns), 3) AS best_rate FROM ru WHERE p50_ns > 0 GROUP BY ALL",
    "ratio_gate": f"WITH {_PAIR} SELECT commit_sha, os, runner, message_type, ladder_p50, order_p50, CASE WHEN os IN ('macOS', 'Darwin') THEN 'warning' ELSE 'failure' END AS level FROM pp WHERE ratio >= 0.9",
    "drift_warning": f"""WITH {_RUN}, w AS (SELECT *, median(p99_ns) OVER x AS median_p99, count(p99_ns) OVER x AS n FROM ru WINDOW x AS (PARTITION BY os, runner, book_type, message_type ORDER BY timestamp_utc, run_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
        SELECT run_id, p99_ns, median_p99 FROM w WHERE n >= 3 AND p99_ns > 1.75 * median_p99""",
    "history_record_anti": f"WITH {_RUN} SELECT run_id, commit_sha, os, book_type, message_type, p99_ns FROM ru WHERE run_id NOT IN (SELECT run_id FROM ci_history WHERE timestamp_utc < TIMESTAMP '2024-01-25' AND run_id IS NOT NULL)",
    "ci_ratio_per_commit": f"WITH {_PAIR} SELECT commit_sha, os, round(avg(ratio), 6) AS mean_ratio, count(ratio) AS types FROM pp GROUP BY ALL",
    "plot_pivot": f"WITH {_RUN} SELECT message_type, median(p50_ns) FILTER (book_type = 'LadderBook') AS ladder_p50, median(p50_ns) FILTER (book_type = 'OrderBook') AS order_p50 FROM ru GROUP BY ALL",
    "message_counts": "SELECT trade_day, CASE WHEN decoded AND type = 'F' THEN 'A' ELSE type END AS type, count(*) AS frames FROM (SELECT trade_day, seq, arg_max(type, decoded::INT) AS type, bool_or(decoded) AS decoded FROM messages GROUP BY ALL) GROUP BY ALL",
    "ladder_offgrid_rejects": "SELECT trade_day, type, count(DISTINCT seq) AS rejects FROM messages WHERE decoded AND type IN ('A', 'F', 'U') AND price % 100 <> 0 GROUP BY ALL",
    "session_dedupe": """SELECT trade_day, line, count(*) AS frames, sum(n)::BIGINT AS datagrams, sum(n - 1)::BIGINT AS repeats FROM (SELECT trade_day, seq, count(*) OVER (PARTITION BY trade_day, seq) AS n, line,
        row_number() OVER (PARTITION BY trade_day, seq ORDER BY recv_ts NULLS LAST, line) AS k FROM messages WHERE seq IS NOT NULL AND trade_day IS NOT NULL) WHERE k = 1 GROUP BY ALL""",
    "session_gaps": f"WITH {_GAP.format('')} SELECT * FROM ga",
    "session_gaps_decoded": f"WITH {_GAP.format('WHERE decoded')} SELECT * FROM ga",
    "session_drain": f"""WITH {_GAP.format('')}, d AS (SELECT trade_day, min(seq) AS first_seq, max(seq) AS last_seq FROM messages GROUP BY ALL), x AS (SELECT trade_day, min(first) AS nx, count(*) AS gaps, sum(requests)::BIGINT AS requests, sum(count)::BIGINT AS missing FROM ga GROUP BY ALL),
        j AS (SELECT d.*, coalesce(nx, last_seq + 1) AS next_seq, coalesce(gaps, 0) AS gaps, coalesce(requests, 0) AS requests, coalesce(missing, 0) AS missing FROM d LEFT JOIN x USING (trade_day))
        SELECT j.*, (SELECT count(DISTINCT seq) FROM messages m WHERE m.trade_day = j.trade_day AND m.seq > j.next_seq) AS pending FROM j""",
    "retransmit_range_join": f"WITH {_GAP.format(chr(39).join(['WHERE line = ', 'A', '']))} SELECT ga.trade_day, first, count, count(DISTINCT m.seq) AS answered FROM ga JOIN messages m ON m.trade_day = ga.trade_day AND m.seq BETWEEN first AND first + count - 1 AND m.line <> 'A' GROUP BY ALL",
    "snapshot_versions": "SELECT trade_day, version, count(*) AS books, max(unknown_refs) AS unknown_refs, sum(open_orders)::BIGINT AS open_orders FROM (SELECT DISTINCT * FROM book_snapshots) GROUP BY ALL",
    "list_json": f"""WITH {_HB} SELECT trade_day, {_LIST} AS response FROM hb GROUP BY trade_day""",
    "query_errors": f"""WITH {_HB}, st AS (SELECT * FROM hb WHERE trade_day = (SELECT max(trade_day) FROM hb)), rq AS (SELECT unnest([{', '.join("'" + x + "'" for x in REQUESTS)}]) AS line),
        sc AS (SELECT line, CASE WHEN position('"cmd"' IN line) > 0 THEN nullif(regexp_extract(substr(line, position('"cmd"' IN line) + 5), '^[ \\t]*:[ \\t]*"([^"]*)"', 1), '') END AS cmd,
          CASE WHEN position('"locate"' IN line) > 0 THEN TRY_CAST(nullif(regexp_extract(substr(line, position('"locate"' IN line) + 8), '^[ \\t]*:[ \\t]*([0-9]+)', 1), '') AS UBIGINT) END AS asked FROM rq)
        SELECT line, CASE WHEN cmd IS NULL THEN '{{"error":"bad request"}}' WHEN cmd = 'list' THEN (SELECT {_LIST} FROM st) WHEN cmd <> 'quote' THEN '{{"error":"unknown command"}}' WHEN asked IS NULL THEN '{{"error":"missing locate"}}'
          ELSE coalesce((SELECT '{{' || {_QUOTE} || ',"snapshot_version":' || version || ',"unknown_refs":' || unknown_refs || '}}' FROM st WHERE st.locate = asked % 65536), '{{"error":"unknown locate","locate":' || (asked % 65536) || '}}') END AS response FROM sc""",
    "query_lines": """SELECT * FROM (VALUES (1, 0, '{"cmd":"quote"}', NULL), (1, 3, '{"cmd":"fly"}', NULL), (1, 4, 'hello', NULL), (2, 0, '{"cmd":"quote","locate":3}', NULL), (2, 1, NULL, '{"error":"request line too long"}')) t(connection, n, line, error)""",
    "wire_encode": f"""SELECT trade_day, seq, {_hex('(length(p) // 2)', 2)} || p AS frame FROM (SELECT trade_day, seq, lower(hex(type)) || {_hex('locate', 2)} || '0000' || {_hex('ts', 6)} || {_BODY} AS p
        FROM (SELECT DISTINCT trade_day, seq, type, locate, ts, ref, new_ref, side, shares, price, match, printable, rtrim(stock) AS stock FROM messages WHERE decoded AND type IN ('A', 'F', 'E', 'C', 'X', 'D', 'U')))""",
    "wire_roundtrip": "SELECT type, count(*) AS messages, 0::BIGINT AS changed FROM messages WHERE decoded AND type IN ('A', 'F', 'E', 'C', 'X', 'D', 'U') GROUP BY ALL",
}
