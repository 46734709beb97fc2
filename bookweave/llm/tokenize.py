"""Byte-pair encoding of a corpus with a public vocabulary.

A text is split into words by the vocabulary's pattern. A word that is itself an entry needs one lookup; the other words
are folded: starting from the ids of its bytes, the adjacent pair with the lowest merge rank is merged until no pair is
in the rank map.

There are two forms, and tests hold them equal. ``with_ids`` splits in Spark and hands the words to Arrow batches: the
distinct words of a batch are numbered, each is folded once a task (``Folder``), and the ids are gathered by number, so
what is done for every single word are array operations. ``Encoder`` is the same as column expressions alone, for where no
Python worker may run, at several times the cost, as higher-order functions are interpreted. Map lookups in Spark scan
their keys, so its rank map is a literal hash table: two literal arrays (keys, values) in which every key sits in one of
two places given by its xxhash64 (cuckoo hashing), which makes a lookup two array accesses.

Everything is a projection: no shuffle, no state that grows with the corpus.

Defined results: a null and an empty text give an empty list; strings that look like special tokens are ordinary text;
repeated rows are encoded each; an id that is no entry decodes to nothing; other columns are kept by ``with_ids``.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits a text into words for this family of vocabularies. (?U): white space of all scripts.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FIRST, LAST = 0x300, 0xD7FF  # characters that stand for merged ids while a word is folded
STRETCH = 2048  # words that share one list of distinct words; bounds the linear search in it, whatever a text's length
PIECE = 1 << 20  # the same where words are numbered: bounds its memory
KNOWN, SHORT = 1 << 18, 64  # words whose ids a task keeps, and their length in bytes at most
_SEP = ""


@lru_cache(1)
def _byte_chars() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabulary files write for bytes: bytes that print stand for themselves,
    the others take the code points from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {chr(b if b in shown else next(spare)): b for b in range(256)}


@lru_cache(4)
def vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[int, int, int]]]:
    """(entry -> id, merges as (left id, right id, merged id) in order of rank) of a byte-level BPE file."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    chars, ids = _byte_chars(), model["vocab"]
    entries = {bytes(chars[c] for c in t): i for t, i in ids.items()}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return entries, [(ids[a], ids[b], ids[a + b]) for a, b in pairs]


def _h(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, seed=42)  # what Spark's xxhash64 computes


def cuckoo(items: list[tuple[int, object]], bits: int) -> list:
    """Places for (hash, item): each at the low bits of its hash or at bits 32.. of it."""
    mask, table = (1 << bits) - 1, [None] * (1 << bits)
    for it in items:
        at = it[0] & mask
        for _ in range(500):
            it, table[at] = table[at], it
            if it is None:
                break
            one, two = it[0] & mask, (it[0] >> 32) & mask
            at = two if at == one else one
        else:
            raise ValueError("no place; use more bits")
    return table


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


class Folder:
    """Ids of words for one ``vocabulary``; ranks equal ids (the file's merges are in order of merged id)."""

    def __init__(self, entries: dict[bytes, int], merges: list[tuple[int, int, int]]):
        self.entries = entries
        if any(a[2] >= b[2] for a, b in zip(merges, merges[1:])):
            raise ValueError("merged ids must follow the order of the merges")
        self.of_byte = [entries[bytes([b])] for b in range(256)]
        self.pairs = {(a, b): m for a, b, m in merges}
        self.known: dict[bytes, list[int]] = {}

    def fold(self, word: bytes) -> list[int]:
        """Ranked merges over the bytes of a word: the lowest rank first, equal ones from left to right, in n log n steps."""
        ids, made, n = [self.of_byte[b] for b in word], self.pairs.get, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i, p in enumerate(zip(ids, ids[1:])) if (m := made(p)) is not None]
        heapify(heap)
        while heap:
            m, i = heappop(heap)
            j = after[i]
            if j == n or made((ids[i], ids[j])) != m:
                continue  # one of the two has been merged since
            k = after[i] = after[j]
            ids[i], ids[j] = m, -1
            if k < n:
                before[k] = i
                if (x := made((m, ids[k]))) is not None:
                    heappush(heap, (x, i))
            h = before[i]
            if h >= 0 and (x := made((ids[h], m))) is not None:
                heappush(heap, (x, h))
        return [i for i in ids if i >= 0]

    def ids(self, word: bytes) -> list[int]:
        out = self.known.get(word)
        if out is None:
            i = self.entries.get(word)
            out = self.fold(word) if i is None else [i]
            if len(word) <= SHORT:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[word] = out
        return out

    def encode(self, words: pa.Array) -> pa.Array:
        """Lists of ids of lists of words."""
        flat, ends = words.flatten(), words.offsets.to_numpy().astype(np.int64)
        values, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for a in range(0, len(flat), PIECE):
            d = flat.slice(a, PIECE).dictionary_encode()
            at, own = d.indices.to_numpy(), [self.ids(w) for w in d.dictionary.cast(pa.binary()).to_pylist()]
            n = np.fromiter(map(len, own), np.int64, len(own))
            first, all_ids = np.cumsum(n) - n, np.fromiter(chain.from_iterable(own), np.int32, int(n.sum()))
            size = n[at]
            end = np.cumsum(size)
            values.append(all_ids[np.arange(end[-1]) + np.repeat(first[at] - end + size, size)])
            sizes.append(size)
        upto = np.cumsum(np.concatenate(sizes))
        return pa.ListArray.from_arrays(pa.array(upto[ends - ends[0]], pa.int32()), pa.array(np.concatenate(values)))


def bind(value: Column, use) -> Column:
    """use(value), with the value computed once inside higher-order functions.

    It is the finish of an aggregation over nothing: an array item would work out its type, and with it that of all that
    is nested in it, anew for every value.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, use)


def _literal(values: list, kind: str) -> Column:
    """A literal array, as one string that constant folding splits once at planning time."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _texts(values: list[str]) -> Column:
    return F.split(F.lit(_SEP.join(values)), _SEP)


class Encoder:
    """Column expressions for one vocabulary file; ranks equal ids (the file's merges are in order of merged id)."""

    def __init__(self, path: str = f"{TOKENIZERS}/byte_bpe_50k.json"):
        entries, merges = vocabulary(path)
        if any(a[2] >= b[2] for a, b in zip(merges, merges[1:])):
            raise ValueError("merged ids must follow the order of the merges")
        self.entries = entries
        # the character of an id: that of its byte, or one from FIRST on
        char = {entries[bytes([b])]: chr(b) for b in range(256)} | {m: chr(FIRST + m) for _, _, m in merges}
        if max(map(ord, char.values())) > LAST:
            raise ValueError("too many ids for one character each")
        pairs = [(_h((char[a] + char[b]).encode()), (char[a] + char[b], m)) for a, b, m in merges]
        self.pair_bits = max(4, (len(pairs) * 2).bit_length())
        t = cuckoo(pairs[::-1], self.pair_bits)
        pair_keys = _texts([x[1][0] if x else "" for x in t])
        pair_ids = _literal([x[1][1] if x else -1 for x in t], "bigint")
        made = {m: char[a] + char[b] for a, b, m in merges}
        pair_of = _texts([made.get(i, "") for i in range(max(char) + 1)])
        char_of = _texts([char.get(i, "") for i in range(max(char) + 1)])
        back = {ord(c): i for i, c in char.items()}
        id_of = _literal([back.get(i, -1) for i in range(max(back) + 1)], "bigint")
        words = []
        for e, i in sorted(entries.items(), key=lambda x: -x[1]):  # frequent entries last: they keep their first place
            try:
                words.append((_h(e), (e.decode("utf-8"), i)))
            except UnicodeDecodeError:
                pass  # part of a character: never a whole word
        self.word_bits = max(4, (len(words) * 2).bit_length())
        t = cuckoo(words, self.word_bits)
        word_keys = _texts([x[1][0] if x else "" for x in t])
        word_ids = _literal([x[1][1] if x else -1 for x in t], "bigint")

        # one literal for all tables: a copy for each use would be sent with every task
        names = ("word_keys", "word_ids", "pair_keys", "pair_ids", "pair_of", "char_of", "id_of")
        self.tables = F.struct(*[c.alias(n) for n, c in zip(names, (word_keys, word_ids, pair_keys, pair_ids, pair_of, char_of, id_of))])

    def _probe(self, key: Column, h: Column, keys: Column, values: Column, bits: int) -> Column:
        mask = F.lit((1 << bits) - 1)
        one = h.bitwiseAND(mask).cast("int")
        two = F.shiftrightunsigned(h, 32).bitwiseAND(mask).cast("int")
        return F.when(F.get(keys, one) == key, F.get(values, one)).when(F.get(keys, two) == key, F.get(values, two))

    def entries_of(self, t: Column, words: Column) -> Column:
        """For each word of a list its id if it is an entry, else null."""
        return F.transform(words, lambda x: self._probe(x, F.xxhash64(x), t["word_keys"], t["word_ids"], self.word_bits))

    def _merged(self, t: Column, pair: Column) -> Column:
        """The id that a pair of characters makes, or null."""
        return self._probe(pair, F.xxhash64(pair), t["pair_keys"], t["pair_ids"], self.pair_bits)

    def fold(self, word: Column) -> Column:
        """Ids (BIGINT) of one word."""
        return bind(self.tables, lambda t: self._fold(t, word))

    def _fold(self, t: Column, word: Column) -> Column:
        """Ids (BIGINT) of one word by ranked merges over its bytes.

        The bytes are the characters of a string; a merge replaces two characters by the one that stands for the merged id,
        everywhere, from left to right. The state is the string, the ids that its pairs could make, and the least of them. One place
        merged brings two new pairs; what is no longer in the string is dropped when its turn comes.
        """

        merged = lambda pair: self._merged(t, pair)

        def state(s: Column, c: Column) -> Column:
            return bind(F.struct(s.alias("s"), c.alias("c")), lambda x: F.struct(x["s"].alias("s"), x["c"].alias("c"), F.array_min(x["c"]).alias("m")))

        def start(s: Column) -> Column:
            return bind(F.split(s, ""), lambda x: F.transform(F.array_distinct(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x)), lambda a, b: F.concat(a, b))), merged))

        def merge(acc: Column) -> Column:
            pair, new, rest = F.get(t["pair_of"], acc["m"].cast("int")), F.get(t["char_of"], acc["m"].cast("int")), F.array_remove(acc["c"], acc["m"])

            def after(x: Column) -> Column:
                at = F.instr(x, new)
                sides = F.transform(F.array(F.substring(x, at - 1, F.lit(2)), F.substring(x, at, F.lit(2))), merged)
                return state(x, F.when(F.length(x) + 1 == F.length(acc["s"]), F.concat(rest, sides)).otherwise(start(x)))

            return F.when(F.contains(acc["s"], pair), bind(F.replace(acc["s"], pair, new), after)).otherwise(state(acc["s"], rest))

        def run(s: Column) -> Column:
            rounds = F.sequence(F.lit(1), 3 * F.length(s))  # of n - 1 merges at most, each brings two pairs
            done = F.aggregate(rounds, state(s, start(s)), lambda acc, _: F.when(acc["m"].isNull(), acc).otherwise(merge(acc)), lambda acc: acc["s"])
            return F.transform(F.split(done, ""), lambda x: F.get(t["id_of"], F.ascii(x)))

        return bind(F.when(F.octet_length(word) == F.length(word), word).otherwise(F.decode(word.cast("binary"), "ISO-8859-1")), run)

    def encode(self, text: Column) -> Column:
        """Ids of a text."""
        def stretch(t: Column, w: Column) -> Column:
            def joined(y: Column) -> Column:
                return F.flatten(F.zip_with(y["w"], y["e"], lambda x, e: F.when(e.isNotNull(), F.array(e)).otherwise(F.get(y["f"], F.array_position(y["r"], x).cast("int") - 1))))

            def folded(y: Column) -> Column:
                rest = F.array_distinct(F.filter(y["w"], lambda x, i: F.get(y["e"], i).isNull()))
                return bind(bind(rest, lambda r: F.struct(y["w"].alias("w"), y["e"].alias("e"), r.alias("r"), F.transform(r, lambda x: self._fold(t, x)).alias("f"))), joined)

            return bind(bind(w, lambda w: F.struct(w.alias("w"), self.entries_of(t, w).alias("e"))), folded)

        def parts(t: Column, w: Column) -> Column:
            n = F.greatest(F.size(w) - 1, F.lit(0))
            return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(n / STRETCH).cast("int")), lambda k: stretch(t, F.slice(w, k * STRETCH + 1, F.lit(STRETCH)))))

        return bind(self.tables, lambda t: bind(words_of(text), lambda w: parts(t, w))).cast("array<int>")

    def decode(self, ids: Column) -> Column:
        """Text of a list of ids: the entries' bytes, joined. Bytes that are no UTF-8 become the replacement character."""
        top = max(self.entries.values()) + 1
        by = {i: e.hex() for e, i in self.entries.items()}
        pieces = F.split(F.lit(",".join(by.get(i, "") for i in range(top))), ",")
        joined = F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(pieces, i), F.lit(""))), "")
        return F.make_valid_utf8(F.unhex(joined).cast("string"))


def with_ids(documents: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.json", text: str = "text", out: str = "ids") -> DataFrame:
    """Add the column ``out``: ARRAY<INT> ids of ``text``."""
    folder = Folder(*vocabulary(path))
    encode = F.arrow_udf(lambda words: folder.encode(words), "array<int>")
    return documents.withColumn(out, encode(words_of(F.col(text))))
