r"""Template residue, filler, error pages and script notices in place of a file.

Normalised lines are counted by host (the repository a file comes from), over all documents; a line that at least
``MIN_DIFFERENT`` different documents of a host share is its boilerplate (licence headers, banners, common lines) and is
subtracted. What is left of a document, its residual, is evidence (a placeholder, filler, a few words over and over, a
left-over hint, an error message, a notice that scripts are required) or content. A document is residue if its residual
has evidence and next to no content, and if the evidence is not outweighed by what was subtracted (a file that consists of
boilerplate and one odd line is no residue): real files keep their content whatever marks stand beside it.

What counts as evidence is composed of word classes (a failure and the thing that fails, scripts and their being
required, a verb of writing and what is to be written), not of the sentences of any corpus. The classes may be wide,
because they alone decide nothing: a file with content is kept however many of its lines match.

Of a line of more than ``SPAN`` words, each clause is judged, and the words that its marks do not account for are content.
Segments of at most two words are scraps, counted apart with characters that stand alone: a message may have a few of
them, a style sheet or a word list consists of them.

"Different documents": copies of one file must not make all of its lines boilerplate. Each document has a signature (the
least hash of its lines, which near copies share); the different signatures of a line are counted exactly, in two steps
(distinct pairs of line and signature, then their number), so a line that a third of all documents share is spread over
all tasks. Lines are then looked up among the boilerplate under a salted key.

Most documents are settled without their text: a line that cannot be evidence (``possible`` is a superset of the judge, line
by line) is reduced to its number of words. Only where these leave no more than ``MAX_CONTENT`` words of content are the other lines
judged. And where the words of such lines outweigh all others by more than ``MAX_CONTENT``, whichever of them are boilerplate, the
document is no residue (``unsettled``): they would be content, or be subtracted and outweigh the evidence. Its lines are tried only until
that is certain, whatever the rest holds. No document is settled by its length, a prefix or a sample.

Defined results: null, empty and blank texts are no residue; a null host is a host of its own; a repeated row of a document is
judged alike and reported once; a null doc_id is reported as null if any such row is residue alone; columns not named are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweave.llm.tokenize import bind

MIN_DIFFERENT = 4  # different documents of a host that make a line boilerplate
MAX_CONTENT = 8  # words of content a residual may have
MAX_SCRAPS = 12  # words a residual may have in segments of at most two words: codes, ids and tags beside a message
SPAN = 18  # words that a mark accounts for at most: all of a short line, or its own clause and those beside it
SALTS = 8  # parts of a hot line's rows when it is looked up
CLAUSE = r"(?<=[.!?;,])\s+"
MARK = ""  # stands for a placeholder
WORD = r"\w\x{80}-\x{10ffff}"  # letters and digits of ASCII, _, and all that is not ASCII

# The syntaxes of unfilled placeholders.
PLACEHOLDER = (
    r"\{\{ ?\w+(?:\.\w+)? ?\}\}|\[\[ ?\w+ ?\]\]|<%=? ?\w+ ?%>|\{% ?\w+ ?%\}|<your [\w ]+>|<[A-Z][A-Z_]+>|\$\{[A-Z_]+\}|%[A-Z][A-Z_]+%|__[A-Z][A-Z_]*__|@@\w+@@|"
    r"§\w+§|#\{\w+\}|YOUR_\w+?_HERE|REPLACE_?ME\w*|CHANGE_?ME\w*|\[(?:INSERT|YOUR|ADD) [\w ]+\]|(?i:xxx [\w ]+? goes here xxx)"
)
# The common filler passage, its words cut to stems (they are often misspelt or inflected), and metasyntactic words.
FILLER_STEMS = (
    "adipi aliqu amet anim aute cillu commod conse culpa cupida deseru dolor duis eiusmo elit enim esse excep exerci fugia incidid ipsum irur labor "
    "lorem magna minim mollit nisi nostr nulla occae offici pariat proide quis repreh sed sint sunt tempo ullam velit venia volupt"
)
FILLER_WORDS = "ad ea est et eu ex id in non qui sit ut foo bar baz qux quux blah"
# Word classes, in English and the words for them that error pages of other languages use.
FAIL = (
    "don't doesn't didn't isn't aren't wasn't weren't hasn't haven't hadn't couldn't wouldn't shouldn't can't won't not no cannot panic\\w* fault\\w* undefined uncaught incorrect insufficient unsupported corrupt\w* disconnect\w* unable "
    " fail\\w* error\\w* invalid denied refus\\w* reject\\w* forbidden unauthori\\w* missing gone remov\\w* delet\\w* moved "
    "expir\\w* exceed\\w* time-?out timed disabled block\\w* suspend\\w* banned down offline wrong broken unknown unavailable unreachable closed maintenance overload\\w* busy "
    "limit\\w* throttl\\w* crash\\w* abort\\w* stopped ended unexpected problem trouble sorry oops too hit\\w* erreur fehler errore erro nicht kein\\w* pas introuvable indisponible "
    "denegad\\w* negad\\w* encontr\\w* trouv\\w* gefunden verweigert gibt interdit requis ran run restricted private"
)
THING = (
    "page\\w* file resource\\w* object document\\w* urls? uri links? address site\\w* website server service\\w* gateway hosts? requests? response access\\w* permission\\w* account repo\\w* "
    "bucket keys? session connect\\w* network upstream proxy client users? you your log_?in sign download mirror content path remote database domain people load\\w* quota rate "
    "process memory pointer command module package version argument operation method query copy blob something answer view read serv\\w* fetch\\w* seite datei p.gina archivo fichier serveur servidor zugriff acceso acc.s anfrage solicitud demande diese interne requested"
)
SCRIPTING = "java_?script ecmascript scripts? scripting js"
NEEDED = (
    "enabl\\w* turn\\w* switch\\w* activ\\w* aktiv\\w* allow\\w* requir\\w* need\\w* must necessar\\w* disabled off blocked support\\w* without only habilit\\w* browser\\w* "
    "reload refresh cookies on execut\\w* n.cessaire erforderlich ben.tigt requiere"
)
WRITE = "write add insert describe explain list replace put fill delete remove edit update provide enter type say give specify choose customi[sz]e change set mention name state summari[sz]e tell document show include"
ABOUT = (
    "here yours? this below should how who what why when which project example\\w* set-?up steps? choice short brief\\w* sentences? paragraphs? description summary title name usage "
    "licen[cs]e install\\w* authors? contribut\\w* features? introduction code text content purpose section placeholder"
)
# Phrases that stand for themselves, each from a word's beginning: reason phrases of the protocol, what follows them, challenges, hints.
PHRASES = [
    "not ?found", "forbidden", "bad (?:gateway|request)", "unauthori[sz]ed", "gateway time-?out", "time-?out", "service unavailable", "internal server error", "too many requests",
    "method not allowed", "access ?denied", "acceso denegado", "zugriff verweigert", "acc.s refus.", r"no ?such ?\w+", r"expired ?\w+", r"invalid ?\w+", "does(?: not|n't) exist",
    "page (?:is|was) (?:not|missing)", "try(?: it)? (?:again|later)", "come (?:again|back|later)", "check (?:again|back|later)", "please retry", "wait and retry", r"cannot \w+", r"can not \w+", r"unable to \w+", r"failed to \w+", r"could not \w+", "panic: ", "fault: ", "authori[sz]ation required", "versuchen sie", r"r.essay\w*", r"int.ntelo", "go back", "back to",
    "return to", "home ?page", "has been (?:told|notified|informed|logged|reported|removed|deleted|moved|disabled|blocked|suspended)", "have been (?:told|notified|informed|logged|reported)", "sign in",
    "log in", r"looked (?:for|every)\w*", "contact (?:us|your|the)", "temporarily", "checking your browser", "you are (?:a )?human", "just a moment", "enable it", "ddos protection",
    "goes (?:here|in)", "to be (?:written|added|filled|done|decided|determined|announced)", "coming soon", "work in progress", "under (?:construction|maintenance)", "limit exceeded", "connection lost", "lost connection", "please slow ?down", "placeholder", "fill (?:in|me)", "sample text", "dummy text",
    "sentence that", r"traceback \(", 'file ".*", line [0-9]+',
]
# Whole segments: headings of templates and one-word messages.
WHOLE = [
    *[w + r" (?:awesome |new )?(?:project|app|library|package|product)(?:'s)?(?: (?:title|name))?" for w in ("my", "your", "the")],
    *[w + " (?:title|name)" for w in ("project", "app", "library", "package", "product")], "titled?", "untitled", r"name of the \w+", "tbd", "tba", "gone", "removed", "slow ?down",
]
# Syntaxes of reports: status codes, exceptions, tool messages, members of a response body.
REPORTS = (
    r"^\W*(?:http\S* ?)?(?:error|status|code)?:? ?[45]\d\d\b(?! ?[,;)\]}]).{0,100}$|^(?:un\w+ )?\w*(?:error|exception): ?|^(?:fatal|error|warning)\w*(?: \w+)?: |"
    r"^\{ ?\"(?:errors?|message|detail|status|code|reason)\" ?:.*\}$|\"(?:errors?|reason|detail|status|code|message)\" ?: ?[\"\d]"
)
# The members of an error message that is the body of a response.
BODY = (
    r"^\{ ?\"(?:errors?|message)\" ?: ?\"(?:[^\"\\]++|\\.)*+\" ?(?:, ?\"(?:documentation_?url|errors?|message|code|status|status_?code|reason|details?|request_?id|timestamp|path|title|type|url|success)\""
    r" ?: ?(?:\"(?:[^\"\\]++|\\.)*+\"|[\w.+-]++) ?){0,9}+\}$"
)
# Licence headers.
LICENCE = r"spdx-licen[cs]e|copyright (?:\(c\) )?\d|\blicen[cs]ed? under|all rights reserved|see the licen[cs]e"


EDGE = "(?![a-z0-9_])"
PROSE = r"""(?= +[a-z<\[{$%_@"'`(\ue001])"""  # what follows is a word, not the syntax of a call or an assignment


def _grouped(words: list[str]) -> str:
    """Alternatives, those that begin with the same plain letter as one."""
    groups: dict[str, list[str]] = {}
    for v in sorted(set(words)):
        groups.setdefault(v[0] if re.match("[a-z](?![?*+{])", v) else "", []).append(v)
    return "|".join(groups.pop("", []) + [k + "(?:" + "|".join(v[1:] for v in g) + ")" for k, g in groups.items()])


def _tree(parts: list[tuple[str, str, str]]) -> str:
    """One pattern for (word, before, after) entries that begin where no letter or digit is before them, grouped by their
    first characters, so that few alternatives are tried at a place; ``before`` is a look-behind in which % stands for the
    first character."""
    groups: dict[str, dict[tuple[str, str], list[str]]] = {}
    for word, before, after in parts:
        w = word.replace("_", " ")
        groups.setdefault(w[0], {}).setdefault((before, after), []).append(w[1:])
    one = {k: k + "(?:" + "|".join(b.replace("%", k) + "(?:" + _grouped(v) + ")" + a for (b, a), v in g.items()) + ")" for k, g in sorted(groups.items())}
    keys = "".join(one)
    few = [keys[i : i + 5] for i in range(0, len(keys), 5)]
    return f"(?=[{keys}])(?<![a-z0-9_])(?:" + "|".join(f"(?=[{f}])(?:" + "|".join(one[k] for k in f) + ")" for f in few) + ")"


def _class(words: str, before: str = "", after: str = "") -> list[tuple[str, str, str]]:
    return [(w, before, EDGE + after) for w in words.split()]


def _near(words: str) -> str:
    """A word of the class within 400 characters of the line."""
    return "(?=.{0,400}?" + _tree(_class(words)) + ")"


# All in a lower-case line.
_FILL = " ".join(s + r"\w*" for s in FILLER_STEMS.split()) + " " + FILLER_WORDS
FILLER, FILLERS = _tree(_class(_FILL)), _tree(_class(_FILL, "", _near(_FILL)))
_PAIRS = _class(FAIL, "", _near(THING)) + _class(THING, "", _near(FAIL)) + _class(SCRIPTING, "", _near(NEEDED)) + _class(NEEDED, "", _near(SCRIPTING))
SAYS = "^(?:" + _tree(_class(WRITE, "", PROSE + _near(ABOUT))) + "|(?:" + "|".join(WHOLE) + r")\W*$)|" + _tree(_PAIRS + [(x, "", "") for x in PHRASES]) + "|" + REPORTS
# A status code where a segment may begin or behind what it is called.
_NUMBER = r"[45]\d\d(?![0-9])(?! ?[,;)\]}])(?<![0-9]...)(?<=(?:^|[\n>.!?;,]|error|status|code|http[^ ]{0,12})[^a-z0-9\n]{0,6}[45]\d\d)"


def _could(pairs: list[tuple[str, str, str]]) -> str:
    """SAYS with anchors that hold for any part of a line, or two words of filler."""
    tree = pairs + [(x, "", "") for x in PHRASES] + _class(WRITE, "(?<![a-z0-9] %)", PROSE + _near(ABOUT)) + _class(_FILL, "", _near(_FILL))
    tree += [(x, "", r"""[\s*/"'`-]*(?:\W*$|<|[.!?;,])""") for x in WHOLE] + [(f"{x}\\w*(?: \\w+)?: ", "", "") for x in ("fatal", "error", "warning")]
    return "(?m)" + _tree(tree) + r'|e(?:rror|xception):|"(?:errors?|message|detail|status|code|reason)" ?:|' + _NUMBER


# What no text has a line with evidence without; and the same of a line, cheaper, as it leaves out the second word of a pair.
COULD_TEXT, COULD = _could(_PAIRS), _could(_class(f"{FAIL} {SCRIPTING}"))
SIGN = "(?=[{\\[<$%_@§#YRCXx])(?:" + PLACEHOLDER + "|(?i:<style))"
TAG = r"<!--|-->|<!?[A-Za-z/?][^<>]*>"


def _clean(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r"), F.lit("\n")), F.lit("\t"), F.lit(" "))


def _lines(text: Column) -> Column:
    return F.split(_clean(text), "\n")


def _normal(line: Column) -> Column:
    """Lower case, and every number alike."""
    return F.trim(F.regexp_replace(F.lower(line), "[0-9]+", "0"))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"[{WORD}]{{2,}}"), F.lit(0))


def _repeated(words: Column) -> Column:
    """The same few words over and over."""

    def few(w: Column) -> Column:
        n = F.size(w)
        return F.when(n >= 6, bind(F.size(F.array_distinct(w)), lambda d: (d * 3 <= n) & (d <= 10)) & ~F.exists(w, lambda x: ~x.rlike("^[A-Za-z]+$"))).otherwise(False)

    return bind(words, few)


def _filled(low: Column, n: Column) -> Column:
    return (n >= 2) & low.rlike(FILLERS) & (F.regexp_count(low, F.lit(FILLER)) >= 0.5 * n)


def _odd(line: Column, words: Column | None = None) -> Column:
    parts = F.split(F.regexp_replace(line, TAG, "\n"), "\n")
    return _repeated(_words(line) if words is None else words) | F.when(F.contains(line, F.lit("<")), F.exists(parts, lambda x: _repeated(_words(x)))).otherwise(False)


def possible(line: Column, n: Column) -> Column:
    """Whether a line of n words may hold evidence: a superset of the judge's."""
    return line.rlike(SIGN) | F.lower(line).rlike(COULD) | F.when(n >= 6, _odd(line)).otherwise(False)


def unsettled(text: Column) -> Column:
    """Whether the words of a text leave open that it is residue.

    Lines that cannot hold evidence have p words that are content or subtracted, and evidence has at most the u words of all other
    lines. Residue has at most ``MAX_CONTENT`` words of content and at least as many of evidence as were subtracted, so p <= MAX_CONTENT + u.
    The sum p - u begins with every word in u and only grows line by line: once it is above ``MAX_CONTENT`` no more lines are tried.
    A sign may split a word in two, so a text with one stays open.
    """

    def weighed(acc: Column, line: Column) -> Column:
        def add(x: Column) -> Column:
            n, low = F.size(x["w"]), x["low"]
            apart = (n <= 2) | F.contains(line, F.lit("<")) | F.contains(low, F.lit("licen")) | F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("all rights"))  # may be no content
            return F.when(F.when(n >= 6, _odd(line, x["w"])).otherwise(n == 0), acc).when(apart, acc + n).otherwise(acc + 2 * n)

        return F.when((acc > MAX_CONTENT) | line.isNull(), acc).otherwise(bind(F.struct(_words(line).alias("w"), F.lower(line).alias("low")), add))

    clean = _clean(text)
    # one search for the whole text: to begin one for each line costs more than to search it
    marked = F.split(F.regexp_replace(F.lower(clean), f"(?={COULD})", MARK), "\n")
    plain = F.zip_with(F.split(clean, "\n"), marked, lambda x, m: F.when(~F.contains(m, F.lit(MARK)), x))
    return clean.rlike(SIGN) | (F.aggregate(plain, -F.size(_words(clean)), weighed) <= MAX_CONTENT)


def may_hold(text: Column) -> Column:
    """Whether any line of a text is ``possible``; every text is tried whole."""
    return _clean(text).rlike(SIGN) | F.lower(text).rlike(COULD_TEXT) | F.exists(_lines(text), lambda x: F.when(F.length(x) >= 17, _odd(x)).otherwise(False))


def _bare(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"^[\s/#*\"'`;%-]+(?:(?i:todo|fixme|hint|note)\W+)?|^(?i:todo|fixme|hint|note)\W+|[\s*/\"'`-]+$", ""))


def _judged(line: Column) -> Column:
    """array of (e: evidence 0/1, c: words of content, s: words of scraps, k: words that marks account for) of a line's segments between mark-up tags."""
    clean = F.regexp_replace(F.regexp_replace(line, r"(?i)<style\b[^>]*>.*?</style>", " "), PLACEHOLDER, f" {MARK} ")
    segments = F.split(F.regexp_replace(clean, TAG, "\n"), "\n")

    def says(t: Column) -> Column:
        return F.lower(t).rlike(SAYS)

    def clauses(t: Column) -> Column:
        """Words that the marks of a long segment account for."""
        own = F.aggregate(F.filter(F.split(t, CLAUSE), says), F.lit(0), lambda a, x: a + F.least(F.size(_words(x)), F.lit(SPAN)))
        return F.when(F.lower(t).rlike(BODY), F.lit(2**31 - 1)).otherwise(bind(own, lambda k: F.when(k > 0, F.greatest(k, F.lit(SPAN))).otherwise(0)))

    def judge(x: Column) -> Column:
        s, w, m, t = x["s"], x["w"], x["m"], x["t"]
        n = F.size(w)
        evident = ((m > 0) & (n <= 8 + 4 * m)) | _filled(F.lower(s), n) | _repeated(w)
        told = F.when(n <= SPAN, F.when(says(t), F.greatest(n, F.lit(1))).otherwise(0)).otherwise(clauses(t))
        licence = F.lower(t).rlike(LICENCE)

        def out(k: Column) -> Column:
            plain = F.when((n <= 2) | ((k == 0) & licence), 0).otherwise(F.greatest(n - k, F.lit(0)))
            scraps = F.when((k > 0) | (n > 2) | licence, 0).otherwise(F.regexp_count(s, F.lit(f"[{WORD}]+")))
            return F.struct(F.when(k > 0, 1).otherwise(0).alias("e"), plain.alias("c"), scraps.alias("s"), F.least(k, n).alias("k"))

        return bind(F.when(evident, F.greatest(n, F.lit(1))).otherwise(told), out)

    def parts(s: Column) -> Column:
        return F.struct(s.alias("s"), _words(s).alias("w"), (F.length(s) - F.length(F.replace(s, F.lit(MARK), F.lit("")))).alias("m"), _bare(s).alias("t"))

    return F.transform(F.filter(segments, lambda s: F.trim(s) != ""), lambda s: bind(parts(s), judge))


def _plain(line: Column, n: Column) -> Column:
    """(c, s): words of content and of scraps of a line without evidence, as the judge counts them."""

    def counted(x: Column, k: Column) -> Column:
        low = F.lower(x)
        licence = (F.contains(low, F.lit("licen")) | F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("all rights"))) & low.rlike(LICENCE)
        scraps = F.when((k > 2) | licence, 0).otherwise(F.regexp_count(x, F.lit(f"[{WORD}]+")))
        return F.struct(F.when((k <= 2) | licence, 0).otherwise(k).alias("c"), scraps.alias("s"))

    parts = F.transform(F.split(F.regexp_replace(line, TAG, "\n"), "\n"), lambda x: bind(F.size(_words(x)), lambda k: counted(x, k)))
    total = {k: F.aggregate(F.transform(parts, lambda x: x[k]), F.lit(0), lambda a, x: a + x) for k in "cs"}  # noqa: B023
    return F.when(F.contains(line, F.lit("<")), F.struct(total["c"].alias("c"), total["s"].alias("s"))).otherwise(counted(line, n))


def boilerplate(documents: DataFrame, host: str = "repo") -> DataFrame:
    """(h): hashes of (host, normalised line) that at least MIN_DIFFERENT different documents of the host share."""
    d = documents.where("text IS NOT NULL").select(F.coalesce(F.col(host), F.lit("")).alias("host"), "text")
    h = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), lambda x: F.xxhash64("host", _normal(x))))
    d = d.select(h.alias("hs")).where("size(hs) > 0").select(F.explode("hs").alias("h"), F.array_min("hs").alias("sign"))
    return d.distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DIFFERENT).select("h")


def residual(documents: DataFrame, host: str = "repo") -> DataFrame:
    """(doc_id, evidence, content, scraps, marked, subtracted) of the residual of every document that may have evidence and next to no content."""
    d = documents.where("text IS NOT NULL").select("doc_id", F.coalesce(F.col(host), F.lit("")).alias("host"), "text").where(may_hold(F.col("text"))).where(unsettled(F.col("text")))
    lines = d.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "host", F.explode(_lines(F.col("text"))).alias("line")).where("trim(line) <> ''")
    lines = lines.withColumn("n", F.regexp_count("line", F.lit(rf"[{WORD}]{{2,}}"))).withColumn("may", possible(F.col("line"), F.col("n")))
    rows = lines.select("doc_id", "row", F.xxhash64("host", _normal(F.col("line"))).alias("h"), F.when(F.col("may"), F.col("line")).alias("line"), F.when(~F.col("may"), _plain(F.col("line"), F.col("n"))).alias("p"))
    rows = rows.select("doc_id", "row", "h", "line", F.coalesce("p.c", F.lit(0)).alias("c"), F.coalesce("p.s", F.lit(0)).alias("s"))
    rows = rows.where("line IS NOT NULL OR c > 0 OR s > 0").withColumn("salt", F.expr(f"cast(pmod(row, {SALTS}) as int)"))
    common = boilerplate(documents, host).select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("common"))
    seen = rows.join(common, ["h", "salt"], "left")
    own = F.col("common").isNull()
    docs = seen.groupBy("doc_id", "row").agg(
        F.sum(F.when(own, F.col("c")).otherwise(0)).alias("c"), F.sum(F.when(own, F.col("s")).otherwise(0)).alias("s"), F.sum(F.when(own, 0).otherwise(F.col("c"))).alias("b"),
        F.collect_list(F.when(F.col("line").isNotNull(), F.struct("line", own.alias("own")))).alias("lines"),
    ).where(f"c <= {MAX_CONTENT} AND s <= {MAX_SCRAPS} AND size(lines) > 0")
    judged = F.transform("lines", lambda x: F.struct(_judged(x["line"]).alias("j"), x["own"].alias("own")))
    docs = docs.select("doc_id", "row", "c", "s", "b", F.explode(judged).alias("j"))
    total = {k: F.expr(f"aggregate(j.j, 0, (a, x) -> a + x.{k})").alias(f"j{k}") for k in "ecsk"}
    docs = docs.select("doc_id", "row", "c", "s", "b", "j.own", *total.values())
    kept = F.col("own") | (F.col("je") > 0)  # a line of evidence is never subtracted; what its marks do not account for is content
    return docs.groupBy("doc_id", "row").agg(
        F.sum("je").alias("evidence"), (F.max("c") + F.sum(F.when(kept, F.col("jc")).otherwise(0))).alias("content"), (F.max("s") + F.sum(F.when(kept, F.col("js")).otherwise(0))).alias("scraps"),
        F.sum("jk").alias("marked"), (F.max("b") + F.sum(F.when(kept, 0).otherwise(F.col("jc")))).alias("subtracted"),
    ).drop("row")


def residue(documents: DataFrame, host: str = "repo") -> DataFrame:
    """(doc_id) of the documents to exclude."""
    return residual(documents, host).where(f"evidence > 0 AND content <= {MAX_CONTENT} AND scraps <= {MAX_SCRAPS} AND marked >= subtracted").select("doc_id").distinct()


def without_residue(documents: DataFrame, host: str = "repo") -> DataFrame:
    """The documents that are not residue, with all their columns."""
    out = residue(documents, host).where("doc_id IS NOT NULL")
    return documents.join(out, "doc_id", "left_anti").select(*documents.columns)
