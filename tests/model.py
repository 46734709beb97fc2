"""A sequential model of the book rules, and feeds to try it on."""

import random

MESSAGE = (
    "trade_day int, seq long, type string, locate int, ts long, ref long, new_ref long, side string, shares long, price long, match long, printable boolean, "
    "stock string, len int, decoded boolean, line string, recv_ts timestamp_ntz"
)
SIZES = {"A": 36, "F": 40, "E": 31, "C": 36, "X": 23, "D": 19, "U": 35}


def msg(seq, type, locate=1, ref=None, new_ref=None, side=None, shares=None, price=None, day=20240102, decoded=True, line="A", ts=None, match=None):
    return (day, seq, type, locate, ts if ts is not None else seq, ref, new_ref, side, shares, price, match, True if type == "C" else None, "X" if type in ("A", "F") else None, SIZES.get(type, 12), decoded, line, None)


class Window:
    """Prices a ladder covers; ``takes`` widens it or says no."""

    def __init__(self, first):
        base = first if first and 1 <= first <= 100_000_000 else 500_000
        self.lo, self.hi = self.low(base), self.high(base)

    @staticmethod
    def low(p):
        return max(0, p - int(p * 0.30)) // 100 * 100

    @staticmethod
    def high(p):
        return min(2**32 - 1, p + int(p * 0.30))

    def takes(self, p):
        if not self.lo <= p <= self.hi:
            lo, hi = (min(self.lo, self.low(p)) if p < self.lo else self.lo), (max(self.hi, self.high(p)) if p > self.hi else self.hi)
            if (hi - lo) // 100 + 1 > 8_000_000:
                return False
            self.lo, self.hi = lo, hi
        return p % 100 == 0


def replay(rows, ladder=False):
    """(orphans {(day, seq)}, open orders {(day, locate, ref, side, shares, price)}, refused adds)."""
    windows = {}

    def fits(day, loc, price):
        return not ladder or windows[(day, loc)].takes(price)

    once = {}
    for r in rows:
        if r[14] and r[2] in SIZES and r[1] is not None:
            once.setdefault((r[0], r[1]), r)
    book, orphans, refused = {}, set(), set()
    for (day, seq), r in sorted(once.items()):
        t, loc, ref, new, side, shares, price = r[2], r[3], r[5], r[6], r[7], r[8] or 0, r[9]
        k = (day, loc, ref)
        windows.setdefault((day, loc), Window(price if t in "AF" else 0))
        if t in "AF":
            if not fits(day, loc, price) or k in book:
                refused.add((day, seq))
            else:
                book[k] = ["B" if side == "B" else "S", shares, price]
            continue
        o = book.get(k)
        if o is None:
            orphans.add((day, seq))
        elif t == "D":
            del book[k]
        elif t == "U":
            del book[k]
            if not fits(day, loc, price) or (day, loc, new) in book:
                refused.add((day, seq))
            else:
                book[(day, loc, new)] = [o[0], shares, price]
        elif shares >= o[1]:
            del book[k]
        else:
            o[1] -= shares
    return orphans, {(*k, *v) for k, v in book.items()}, refused


def random_feed(seed, n=400, refs=25, prices=tuple(range(100, 900, 100))):
    """Re-used refs, repeated adds, replaces onto open refs and onto themselves, wrong locates, zero shares, repeats."""
    rng = random.Random(seed)
    rows = []
    for seq in range(1, n + 1):
        t = rng.choice("AAAAFEECXDUUU")
        day, loc = rng.choice([20240102, 20240103]), rng.choice([1, 1, 1, 2])
        ref, new = rng.randrange(refs), rng.randrange(refs)
        new = ref if rng.random() < 0.1 else new
        has = t in "AFU"
        r = msg(seq, t, loc, ref, new if t == "U" else None, rng.choice(["B", "S", "b", None]) if t in "AF" else None, None if t == "D" else rng.choice([0, 10, 50, 100]), rng.choice(prices) if has else None, day)
        rows += [r] * rng.choice([1, 1, 1, 2])
    rng.shuffle(rows)
    return rows
