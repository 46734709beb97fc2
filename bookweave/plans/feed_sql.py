"""SQL for the feed queries: an independent sequential replay, for checking the operators.

Refs linked by replaces form small groups; each group is replayed message by message with a recursive query whose state
is the list of its resting orders.
"""

BOOK_SQL = """
ev AS (SELECT trade_day, locate, seq, max(type) AS type, max(ref) AS ref, max(new_ref) AS new_ref, max(side) AS side, max(shares) AS shares, max(price) AS price, max(match) AS match
       FROM messages WHERE decoded AND type IN ('A', 'F', 'E', 'C', 'X', 'D', 'U') GROUP BY trade_day, locate, seq),
link AS (SELECT DISTINCT trade_day, locate, ref AS a, new_ref AS b FROM ev WHERE type = 'U' UNION SELECT DISTINCT trade_day, locate, new_ref, ref FROM ev WHERE type = 'U'),
reach AS (SELECT DISTINCT trade_day, locate, a, a AS r FROM link UNION SELECT x.trade_day, x.locate, x.a, l.b FROM reach x JOIN link l ON x.trade_day = l.trade_day AND x.locate = l.locate AND x.r = l.a),
comp AS (SELECT trade_day, locate, a AS ref, min(r) AS root FROM reach GROUP BY ALL),
o AS (SELECT ev.*, coalesce(comp.root, ev.ref) AS root, row_number() OVER (PARTITION BY ev.trade_day, ev.locate, coalesce(comp.root, ev.ref) ORDER BY seq) AS n
      FROM ev LEFT JOIN comp ON ev.trade_day = comp.trade_day AND ev.locate = comp.locate AND ev.ref = comp.ref),
f AS (
  SELECT DISTINCT trade_day, locate, root, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS type, false AS applied, false AS hit, NULL::STRUCT(ref BIGINT, side VARCHAR, shares BIGINT, price BIGINT) AS cur,
         []::STRUCT(ref BIGINT, side VARCHAR, shares BIGINT, price BIGINT)[] AS book FROM o
  UNION ALL
  SELECT trade_day, locate, root, n, seq, type,
         CASE WHEN type IN ('A', 'F') THEN cur IS NULL WHEN type = 'U' THEN cur IS NOT NULL AND len(list_filter(rest, lambda x: x.ref = new_ref)) = 0 ELSE cur IS NOT NULL END,
         cur IS NOT NULL, cur,
         CASE WHEN type IN ('A', 'F') THEN CASE WHEN cur IS NULL THEN list_append(book, {'ref': ref, 'side': CASE WHEN side = 'B' THEN 'B' ELSE 'S' END, 'shares': shares, 'price': price}) ELSE book END
              WHEN cur IS NULL THEN book
              WHEN type = 'D' THEN rest
              WHEN type = 'U' THEN CASE WHEN len(list_filter(rest, lambda x: x.ref = new_ref)) = 0 THEN list_append(rest, {'ref': new_ref, 'side': cur.side, 'shares': shares, 'price': price}) ELSE rest END
              WHEN shares >= cur.shares THEN rest
              ELSE list_append(rest, {'ref': ref, 'side': cur.side, 'shares': cur.shares - shares, 'price': cur.price}) END
  FROM (SELECT o.*, f.book AS book, list_filter(f.book, lambda x: x.ref = o.ref)[1] AS cur, list_filter(f.book, lambda x: x.ref <> o.ref) AS rest
        FROM f JOIN o ON f.trade_day = o.trade_day AND f.locate = o.locate AND f.root = o.root AND o.n = f.n + 1)),
live AS (SELECT trade_day, locate, unnest(book, recursive := true) FROM (SELECT trade_day, locate, root, arg_max(book, n) AS book FROM f GROUP BY ALL)),
lv AS (SELECT trade_day, locate, side, price, sum(shares)::BIGINT AS shares, count(*)::BIGINT AS orders FROM live GROUP BY ALL),
bk AS (SELECT DISTINCT trade_day, locate FROM ev),
qt AS (SELECT trade_day, locate, max(price) FILTER (side = 'B') AS bid_price, arg_max(shares, price) FILTER (side = 'B') AS bid_shares, min(price) FILTER (side = 'S') AS ask_price,
              arg_min(shares, price) FILTER (side = 'S') AS ask_shares, sum(orders)::BIGINT AS open_orders, count(*) FILTER (side = 'B') AS bid_levels, count(*) FILTER (side = 'S') AS ask_levels
       FROM lv GROUP BY ALL),
snap AS (SELECT bk.trade_day, bk.locate, bid_price, bid_shares, ask_price, ask_shares, coalesce(open_orders, 0)::BIGINT AS open_orders, coalesce(bid_levels, 0)::BIGINT AS bid_levels,
                coalesce(ask_levels, 0)::BIGINT AS ask_levels FROM bk LEFT JOIN qt ON bk.trade_day = qt.trade_day AND bk.locate = qt.locate)
"""

W = f"WITH RECURSIVE {BOOK_SQL}"
FEED_SQL = {
    "book_snapshot": f"{W} SELECT * FROM snap",
    "book_levels": f"{W} SELECT * FROM lv",
    "book_depth_top5": f"{W} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_day, locate, side ORDER BY CASE side WHEN 'B' THEN -price ELSE price END) AS level FROM lv) WHERE level <= 5",
    "open_orders_by_side": f"{W} SELECT trade_day, locate, side, count(*) AS open_orders, sum(shares)::BIGINT AS shares FROM live GROUP BY ALL",
    "unknown_refs_by_type": f"{W} SELECT trade_day, CASE type WHEN 'F' THEN 'A' ELSE type END AS type, count(*) AS unknown_refs FROM f WHERE seq IS NOT NULL AND NOT applied GROUP BY ALL",
    "crossed_books": f"{W} SELECT trade_day, count(*) AS books, count(*) FILTER (bid_price >= ask_price) AS crossed FROM snap GROUP BY ALL",
    "replace_lineage": f"{W} SELECT trade_day, locate, seq, cur.side AS side FROM f WHERE type = 'U' AND hit AND applied",
    "trade_tape": f"""{W} SELECT f.trade_day, f.locate, f.seq, cur.side AS side, CASE WHEN f.type = 'C' THEN ev.price ELSE cur.price END AS price, least(ev.shares, cur.shares) AS shares, ev.match
        FROM f JOIN ev ON f.trade_day = ev.trade_day AND f.locate = ev.locate AND f.seq = ev.seq WHERE f.hit AND f.type IN ('E', 'C')""",
    "replay_report": f"""{W}, fr AS (SELECT trade_day, seq, max(len) AS len, bool_or(decoded) AS decoded, arg_max(type, decoded::INT) AS type FROM messages GROUP BY ALL),
        ty AS (SELECT trade_day, CASE WHEN decoded AND type = 'F' THEN 'A' ELSE type END AS t, count(*) AS n FROM fr GROUP BY ALL),
        m AS (SELECT trade_day, count(*) AS frames, sum(len + 2)::BIGINT AS bytes, count(*) FILTER (decoded) AS decoded FROM fr GROUP BY ALL),
        tc AS (SELECT trade_day, string_agg(t || '=' || n, ' ' ORDER BY t) AS frames_by_type FROM ty GROUP BY ALL),
        s AS (SELECT trade_day, count(*) AS books, sum(open_orders)::BIGINT AS open_orders, sum(bid_levels)::BIGINT AS bid_levels, sum(ask_levels)::BIGINT AS ask_levels FROM snap GROUP BY ALL),
        u AS (SELECT trade_day, count(*) AS unknown_refs FROM f WHERE seq IS NOT NULL AND NOT applied GROUP BY ALL)
        SELECT m.*, frames_by_type, coalesce(books, 0) AS books, coalesce(open_orders, 0) AS open_orders, coalesce(bid_levels, 0) AS bid_levels, coalesce(ask_levels, 0) AS ask_levels, coalesce(unknown_refs, 0) AS unknown_refs
        FROM m JOIN tc USING (trade_day) LEFT JOIN s USING (trade_day) LEFT JOIN u USING (trade_day)""",
    "threeway_diff": f"""{W}, h AS (SELECT DISTINCT trade_day, locate, bid_price, ask_price, open_orders, bid_levels, ask_levels FROM book_snapshots b WHERE version = (SELECT max(version) FROM book_snapshots c WHERE c.trade_day = b.trade_day))
        SELECT coalesce(snap.trade_day, h.trade_day) AS trade_day, count(*) AS books, count(*) FILTER (snap.locate IS NULL OR h.locate IS NULL) AS one_sided,
        count(*) FILTER (snap.bid_price IS DISTINCT FROM h.bid_price OR snap.ask_price IS DISTINCT FROM h.ask_price) AS other_quote, count(*) FILTER (snap.open_orders IS DISTINCT FROM h.open_orders) AS other_open_orders
        FROM snap FULL JOIN h ON snap.trade_day = h.trade_day AND snap.locate = h.locate GROUP BY ALL""",
    "quote_point": f"""{W}, nv AS (SELECT trade_day, count(*) // 2000 + 1 AS version FROM ev GROUP BY ALL), un AS (SELECT trade_day, count(*) AS n FROM f WHERE seq IS NOT NULL AND NOT applied GROUP BY ALL)
        SELECT trade_day, '{{"locate":' || locate || ',"best_bid":' || coalesce(bid_price::VARCHAR, 'null') || ',"best_bid_shares":' || coalesce(bid_shares::VARCHAR, 'null') || ',"best_ask":' || coalesce(ask_price::VARCHAR, 'null')
        || ',"best_ask_shares":' || coalesce(ask_shares::VARCHAR, 'null') || ',"open_orders":' || open_orders || ',"bid_levels":' || bid_levels || ',"ask_levels":' || ask_levels
        || ',"snapshot_version":' || version || ',"unknown_refs":' || coalesce(un.n, 0) || '}}' AS response FROM snap JOIN nv USING (trade_day) LEFT JOIN un USING (trade_day)""",
    "checkpoint_bbo": f"""{W}, ord AS (SELECT trade_day, locate, seq, ceil(row_number() OVER (PARTITION BY trade_day ORDER BY seq, locate) / 2000.0)::BIGINT AS version FROM ev),
        v AS (SELECT trade_day, unnest(range(1, count(*) // 2000 + 2)) AS version FROM ord GROUP BY trade_day),
        born AS (SELECT trade_day, locate, min(version) AS first FROM ord WHERE locate IS NOT NULL GROUP BY ALL),
        st AS (SELECT f.trade_day, f.locate, f.root, ord.version, arg_max(f.book, f.n) AS book FROM f JOIN ord ON f.trade_day = ord.trade_day AND f.locate = ord.locate AND f.seq = ord.seq GROUP BY ALL),
        nx AS (SELECT *, lead(version) OVER (PARTITION BY trade_day, locate, root ORDER BY version) AS nxt FROM st),
        lvv AS (SELECT trade_day, version, locate, side, price, sum(shares)::BIGINT AS shares, count(*) AS orders FROM (SELECT v.trade_day, v.version, nx.locate, unnest(nx.book, recursive := true) FROM nx JOIN v ON nx.trade_day = v.trade_day AND v.version >= nx.version AND (nx.nxt IS NULL OR v.version < nx.nxt)) GROUP BY ALL),
        qq AS (SELECT trade_day, version, locate, max(price) FILTER (side = 'B') AS bid_price, arg_max(shares, price) FILTER (side = 'B') AS bid_shares, min(price) FILTER (side = 'S') AS ask_price,
          arg_min(shares, price) FILTER (side = 'S') AS ask_shares, sum(orders)::BIGINT AS open_orders, count(*) FILTER (side = 'B') AS bid_levels, count(*) FILTER (side = 'S') AS ask_levels FROM lvv GROUP BY ALL)
        SELECT v.trade_day, v.version, born.locate, bid_price, bid_shares, ask_price, ask_shares, coalesce(open_orders, 0)::BIGINT AS open_orders, coalesce(bid_levels, 0)::BIGINT AS bid_levels, coalesce(ask_levels, 0)::BIGINT AS ask_levels
        FROM v JOIN born ON v.trade_day = born.trade_day AND v.version >= born.first LEFT JOIN qq ON qq.trade_day = v.trade_day AND qq.version = v.version AND qq.locate = born.locate""",
    "p1_found": f"""{W} SELECT 'messages' AS src_table, trade_day, seq AS rec_id FROM f WHERE seq IS NOT NULL AND type NOT IN ('A', 'F') AND NOT hit
        UNION SELECT 'executions', trade_day, exec_id FROM executions x WHERE ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT trade_day, locate, ref FROM ev WHERE type IN ('A', 'F')
          UNION SELECT f.trade_day, f.locate, ev.new_ref FROM f JOIN ev ON f.trade_day = ev.trade_day AND f.seq = ev.seq WHERE f.type = 'U' AND f.hit) k WHERE k.trade_day = x.trade_day AND k.locate = x.locate AND k.ref = x.ref)
        UNION SELECT 'fills', trade_day, fill_id FROM fills y WHERE child_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM child_orders c WHERE c.child_id = y.child_id AND c.trade_day = y.trade_day AND c.ts <= y.ts)""",
    "p2_found": f"{W} SELECT trade_day, locate, ref, side, shares, price FROM live",
}
