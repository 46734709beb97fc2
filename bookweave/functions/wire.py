"""The binary feed as column expressions: big-endian messages to typed columns and back, datagram headers, request lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: bytes of each message, and the fields after type, locate, tracking number and time as
# (column, first byte from 0, bytes).
SIZES = {"A": 36, "F": 40, "E": 31, "C": 36, "X": 23, "D": 19, "U": 35}
FIELDS = {
    "A": [("ref", 11, 8), ("shares", 20, 4), ("price", 32, 4)],
    "F": [("ref", 11, 8), ("shares", 20, 4), ("price", 32, 4)],
    "E": [("ref", 11, 8), ("shares", 19, 4), ("match", 23, 8)],
    "C": [("ref", 11, 8), ("shares", 19, 4), ("match", 23, 8), ("price", 32, 4)],
    "X": [("ref", 11, 8), ("shares", 19, 4)],
    "D": [("ref", 11, 8)],
    "U": [("ref", 11, 8), ("new_ref", 19, 8), ("shares", 27, 4), ("price", 31, 4)],
}
HEADER = [("locate", 1, 2), ("ts", 5, 6)]


def be(value: Column, size: int) -> Column:
    """Hex text of a whole number in big-endian bytes (its low bytes; a negative BIGINT is a 64-bit pattern)."""
    return F.substring(F.lpad(F.hex(value.cast("bigint")), 16, "0"), 17 - 2 * size, 2 * size)


def be_int(payload: Column, first: int, size: int) -> Column:
    """Whole number from big-endian bytes; 8 bytes give the BIGINT of the same bit pattern."""
    n = F.conv(F.hex(F.substring(payload, first + 1, size)), 16, 10).cast("decimal(20,0)")
    if size == 8:
        n = F.when(n >= F.lit("9223372036854775808").cast("decimal(20,0)"), n - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(n)
    return n.cast("bigint")


def _text(c: Column, size: int) -> Column:
    return F.hex(F.rpad(F.coalesce(c, F.lit("")), size, " "))


def encode() -> Column:
    """BINARY payload of a decoded row; null for other types. The tracking number and the firm of F are written empty."""
    col = F.col
    head = F.concat(F.hex("type"), be(col("locate"), 2), F.lit("0000"), be(col("ts"), 6))
    add = F.concat(be(col("ref"), 8), _text(col("side"), 1), be(col("shares"), 4), _text(F.rtrim("stock"), 8), be(col("price"), 4))
    execute = F.concat(be(col("ref"), 8), be(col("shares"), 4), be(col("match"), 8))
    flag = F.when(F.col("printable"), "59").otherwise("4E")
    body = (
        F.when(col("type") == "A", add)
        .when(col("type") == "F", F.concat(add, F.lit("20202020")))
        .when(col("type") == "E", execute)
        .when(col("type") == "C", F.concat(execute, flag, be(col("price"), 4)))
        .when(col("type") == "X", F.concat(be(col("ref"), 8), be(col("shares"), 4)))
        .when(col("type") == "D", be(col("ref"), 8))
        .when(col("type") == "U", F.concat(be(col("ref"), 8), be(col("new_ref"), 8), be(col("shares"), 4), be(col("price"), 4)))
    )
    return F.unhex(F.concat(head, body))


def frame(payload: Column) -> Column:
    """A payload behind its two-byte length."""
    return F.concat(F.unhex(be(F.octet_length(payload), 2)), payload)


def type_byte(payload: Column) -> Column:
    """The type as text: the character if it prints, else 0x.. ."""
    h = F.hex(F.substring(payload, 1, 1))
    n = F.conv(h, 16, 10).cast("int")
    return F.when(n.between(33, 126), F.decode(F.substring(payload, 1, 1), "US-ASCII")).otherwise(F.concat(F.lit("0x"), F.lower(h)))


def decode(frames: DataFrame, payload: str = "payload") -> DataFrame:
    """Add the typed columns to rows with a payload. A known type of exactly its length is decoded; any other row keeps its
    type and length, with ``decoded`` false and null fields. Side bytes are kept as they come, stocks lose trailing blanks."""
    p = F.col(payload)
    d = frames.withColumn("type", type_byte(p)).withColumn("len", F.octet_length(p))
    right = F.lit(False)
    for t, n in SIZES.items():
        right = right | ((F.col("type") == t) & (F.col("len") == n))
    d = d.withColumn("decoded", right)

    def field(name: str) -> Column:
        out = F.lit(None).cast("bigint")
        for t, fs in FIELDS.items():
            for f, first, size in fs:
                if f == name:
                    out = F.when(F.col("decoded") & (F.col("type") == t), be_int(p, first, size)).otherwise(out)
        return out

    add = F.col("decoded") & F.col("type").isin("A", "F")
    return d.withColumns(
        {f: F.when(F.col("decoded"), be_int(p, a, n)) for f, a, n in HEADER}
        | {f: field(f) for f in ("ref", "new_ref", "shares", "price", "match")}
        | {
            "locate": F.when(F.col("decoded"), be_int(p, 1, 2)).cast("int"),
            "side": F.when(add, F.decode(F.substring(p, 20, 1), "ISO-8859-1")),
            "stock": F.when(add, F.rtrim(F.decode(F.substring(p, 25, 8), "US-ASCII"))),
            "printable": F.when(F.col("decoded") & (F.col("type") == "C"), F.hex(F.substring(p, 32, 1)) == "59"),
        }
    )


def datagram_header(packet: Column) -> dict[str, Column]:
    """Session (10 bytes, trailing blanks off), sequence number and count of a datagram."""
    return {"session": F.rtrim(F.decode(F.substring(packet, 1, 10), "US-ASCII")), "seq": be_int(packet, 10, 8), "count": be_int(packet, 18, 2)}


def text_field(line: Column, key: str) -> Column:
    """The string after the first "key" of a request line; null if that occurrence is malformed. No escapes."""
    rest = F.substring_index(line, f'"{key}"', 1)
    tail = F.substr(line, F.length(rest) + len(key) + 3)
    got = F.regexp_extract(tail, r'^[ \t]*:[ \t]*"([^"]*)"', 1)
    return F.when(line.contains(f'"{key}"') & tail.rlike(r'^[ \t]*:[ \t]*"[^"]*"'), got)


def number_field(line: Column, key: str) -> Column:
    """The digits after the first "key" of a request line as DECIMAL(20,0); null if malformed or beyond 64 bits."""
    rest = F.substring_index(line, f'"{key}"', 1)
    tail = F.substr(line, F.length(rest) + len(key) + 3)
    n = F.regexp_extract(tail, r"^[ \t]*:[ \t]*([0-9]+)", 1).try_cast("decimal(38,0)")
    return F.when(line.contains(f'"{key}"') & (n <= F.lit("18446744073709551615").cast("decimal(20,0)")), n.cast("decimal(20,0)"))


def _sides() -> list[Column]:
    return [F.col(f"{s}_{c}").alias(f"best_{s}" + "_shares" * (c == "shares")) for s in ("bid", "ask") for c in ("price", "shares")]


def quote_json(*more: str) -> Column:
    """A book as the service writes it; an empty side is null. By default with snapshot_version and unknown_refs."""
    more = more or ("snapshot_version", "unknown_refs")
    return F.to_json(F.struct("locate", *_sides(), "open_orders", "bid_levels", "ask_levels", *[c for c in more if c]), {"ignoreNullFields": "false"})


def list_json(books: DataFrame, by: list[str]) -> DataFrame:
    """(by.., response): all books of each ``by`` in the order of locate. One response holds one day's books (65,536 at most)."""
    entry = F.to_json(F.struct("locate", *_sides(), "open_orders", "bid_levels", "ask_levels"), {"ignoreNullFields": "false"})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("locate", entry.alias("j")))), lambda x: x["j"]), ",")
    g = books.groupBy(*by).agg(text.alias("_b"), F.coalesce(F.max("snapshot_version"), F.lit(0)).alias("_v"), F.coalesce(F.max("unknown_refs"), F.lit(0)).alias("_u"))
    return g.select(*by, F.concat(F.lit('{"snapshot_version":'), "_v", F.lit(',"unknown_refs":'), "_u", F.lit(',"books":['), "_b", F.lit("]}")).alias("response"))


MAX_LINE = 65536  # fixed value: bytes a request line may have


def request_lines(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys.., n, line, error) of what each connection sent: lines end with a line feed, a carriage return before it is dropped,
    empty lines are passed over, and what comes after the last line feed is no request, but an error if it is too long."""
    parts = F.split(F.col(text), "\n")
    p = texts.where(F.col(text).isNotNull()).select(*keys, F.size(parts).alias("_n"), F.posexplode(parts).alias("n", "line"))
    p = p.withColumn("_tail", F.col("n") == F.col("_n") - 1).withColumn("line", F.regexp_replace("line", "\r$", ""))
    error = F.when(F.col("_tail") & (F.octet_length("line") > MAX_LINE), '{"error":"request line too long"}')
    return p.withColumn("error", error).where("(NOT _tail AND line <> '') OR error IS NOT NULL").select(*keys, "n", "line", "error")


def answer(requests: DataFrame, store: DataFrame, line: str = "line") -> DataFrame:
    """Answer request lines (list, quote) from the books of one snapshot: columns locate, bid_price, bid_shares, ask_price, ask_shares,
    open_orders, bid_levels, ask_levels, snapshot_version, unknown_refs. Before anything is published a list is empty, of version 0.

    A locate is taken modulo 65536, as the service does. Adds ``cmd``, ``asked`` and ``response``."""
    r = requests.withColumn("cmd", text_field(F.col(line), "cmd")).withColumn("asked", number_field(F.col(line), "locate"))
    r = r.withColumn("_at", F.when(F.col("cmd") == "quote", F.pmod(F.col("asked"), F.lit(65536).cast("decimal(20,0)")).cast("int")))
    b = store.select(F.col("locate").alias("_at"), quote_json().alias("_quote"))
    every = list_json(store, []).select(F.lit("list").alias("cmd"), F.col("response").alias("_list"))
    j = r.join(b, "_at", "left").join(every, "cmd", "left")
    response = (
        F.when(F.col("cmd").isNull(), '{"error":"bad request"}')
        .when(F.col("cmd") == "list", F.col("_list"))
        .when(F.col("cmd") != "quote", '{"error":"unknown command"}')
        .when(F.col("asked").isNull(), '{"error":"missing locate"}')
        .when(F.col("_quote").isNull(), F.concat(F.lit('{"error":"unknown locate","locate":'), F.col("_at"), F.lit("}")))
        .otherwise(F.col("_quote"))
    )
    return j.withColumn("response", response).select(*requests.columns, "cmd", "asked", "response")
