"""Text decoded with the wrong character encoding: find it and restore it.

An unknown code-page swap is treated as a substitution cipher. What a cipher may do to a character follows from
the public single-byte code pages by rule: the bytes of one encoding are read as another one (UTF-8 read as a code
page, or one code page read as another). Which letter a run of symbols stands for is learned without labels, by
expectation-maximisation against the bigrams of the language: in the E step each run of non-ASCII characters is
read literally or as each cipher would have it, in proportion to the bigram probability of the reading in its
context and to the cipher's weight in the row's source; in the M step bigrams and weights are counted anew by
these proportions. A row is damaged if, under some cipher, its runs together are likelier decoded than literal.

Swaps among the listed code pages follow by rule, and UTF-8 read as other pages that Python knows. For runs within
words that none of these explains, the EM also learns a table per source, from the run to the letter it stands for: each
letter the bigrams know is a candidate, its weight the share of the run's occurrences that it is expected to explain. The table's
M step is an aggregation on the executors and joins the runs for the next E step; entries that are as good as certain
go out to all tasks at the end, and those of single symbols are applied by ``translate()``.

Defined cases: a null text is never damaged. U+FFFD counts as damage that cannot be undone. Text that is as a whole
(white space aside) the printed form of a byte string is damaged and restored by evaluating its escapes. Doubly
swapped text is undone in turns. Empty text, ASCII text and correct foreign text are not damaged.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.session import Stage

#: Single-byte code pages among which swaps are sought.
CODE_PAGES = ("cp1252", "latin_1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp437", "cp850", "cp852", "cp866", "koi8_r", "mac_roman", "iso8859_2")
#: Weight of a cipher before anything is known, per run.
PRIOR = 0.02
SMOOTH = 0.05
#: Log odds, for each byte beyond a character's first, that symbols forming valid UTF-8 aren't there by chance.
VALID = math.log(20)
#: The same where a character may be several bytes; a third of the second bytes would do.
WIDE_VALID = math.log(3)
EM_ROUNDS = 5
#: A source that was seen this seldom counts half by what all sources together say of a cipher.
DRAW = 200
#: More sources, or more learned entries, are an error: the tables by source go to every task.
MAX_SOURCES, MAX_LEARNED = 100_000, 1_000_000
RUN = re.compile(r"[^\x00-\x7f]+")
BYTES = re.compile(r"(?s)\A\s*b(['\"])(.*)\1\s*\Z")
BYTES_JAVA = r"(?s)\A[\s\p{Z}]*b(?:'.*'|" + '".*")' + r"[\s\p{Z}]*\z"
RUN_LIMIT = 64
#: Pages that UTF-8 may have been read as, besides CODE_PAGES; the whole run must be valid UTF-8 then.
OTHER_PAGES = ("cp1255", "cp1256", "cp1258", "cp874", "cp737", "cp775", "cp855", "cp857", "cp858", "cp860", "cp861", "cp862", "cp863", "cp864", "cp865", "cp869", "cp1125", "iso8859_3", "iso8859_4", "iso8859_5", "iso8859_6", "iso8859_7", "iso8859_8", "iso8859_9", "iso8859_10", "iso8859_11", "iso8859_13", "iso8859_14", "iso8859_15", "iso8859_16", "koi8_u", "koi8_t", "kz1048", "ptcp154", "hp_roman8", "mac_cyrillic", "mac_greek", "mac_iceland", "mac_latin2", "mac_turkish")
WIDE_PAGES = ("gb18030", "cp932", "cp949", "cp950", "big5hkscs", "euc_jp", "euc_kr", "johab")
#: A learned run has at most so many symbols, an entry so many contexts and this weight at least.
LEARNED_LEN, LEARNED_CONTEXTS, LEARNED_WEIGHT = 6, 2, 0.8
LEARNED = -1


def _byte_chars(page: str) -> dict[int, str]:
    """Upper half of a code page; bytes it leaves undefined become the control character of the same number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(page)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


def _valid(run: str, decoded: str) -> float:
    return VALID * (len(run) - len(decoded))


def _valid_wide(run: str, decoded: str) -> float:
    return WIDE_VALID * sum(len(c.encode("utf-8")) - 1 for c in decoded)


class _Utf8As:
    """UTF-8 bytes that were read as a code page, perhaps with the case of the result changed later."""

    def __init__(self, page: str):
        self.name = f"utf8>{page}"
        self.of: dict[str, list[int]] = defaultdict(list)
        chars = _byte_chars(page)
        for b, c in chars.items():
            self.of[c].append(b)
        for b, c in chars.items():
            for v in (c.lower(), c.upper()):
                if len(v) == 1 and b not in self.of[v] and ord(v) > 127:
                    self.of[v].append(b)
        self.valid = _valid
        self.undefined = [b for b in range(0x80, 0x100) if not _defined(page, b)]

    def __call__(self, run: str) -> str | None:
        out, i, hit = [], 0, False
        while i < len(run):
            got = self._unit(run, i)
            if got:
                out.append(got[0])
                i += got[1]
                hit = True
            else:
                out.append(run[i])
                i += 1
        return "".join(out) if hit else None

    def _unit(self, run: str, i: int) -> tuple[str, int] | None:
        """The character whose bytes stand at i, and how many symbols they take. Complete readings go before cut ones, those of
        the page's own case before others; a C1 control is what a second turn of the same damage leaves."""
        found = []
        for n, lead in enumerate(self.of.get(run[i], ())):
            other = n > 0  # the first is the page's own byte for this character
            need = 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0
            if not need:
                continue
            tail = []
            for c in run[i + 1 : i + 1 + need]:
                b = next((x for x in self.of.get(c, ()) if 0x80 <= x <= 0xBF), None)
                if b is None:
                    break
                tail.append(b)
            tries = [(False, bytes([lead, *tail]), 1 + need)] if len(tail) == need else []
            if need == 2 and tail:  # the last byte has no character in this page and was dropped
                tries += [(True, bytes([lead, tail[0], u]), 2) for u in self.undefined[::-1] if u <= 0xBF]
            for cut, raw, used in tries:
                try:
                    c = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                control = "\x80" <= c <= "\x9f"
                if control or unicodedata.category(c) not in ("Cc", "Cn", "Co"):
                    found.append(((cut or control, other, cut), c, used))
        return min(found, key=lambda x: x[0])[1:] if found else None


class _WholeUtf8As:
    """UTF-8 bytes that were read as a page of one or more bytes a character, which may have taken in an ASCII letter."""

    def __init__(self, page: str):
        self.name, self.page = f"utf8>{page}", page
        self.valid = _valid_wide if page in WIDE_PAGES else _valid

    def __call__(self, run: str) -> str | None:
        try:
            out = run.encode(self.page).decode("utf-8")
        except UnicodeError:
            return None
        fit = all(c >= "\x80" or c.isalnum() for c in out) and any(c >= "\x80" for c in out)
        return out if fit and out != run and not any(unicodedata.category(c) in ("Cc", "Cn", "Co", "Mn") for c in out) else None


class _PageAs:
    """Text of one code page that was read as another one."""

    def __init__(self, real: str, read: str):
        self.name, self.valid = f"{real}>{read}", _valid
        a, b = _byte_chars(real), _byte_chars(read)
        self.table = {ord(b[x]): a[x] for x in range(0x80, 0x100) if a[x] != b[x] and b[x] > "\x9f" and a[x] > "\x9f"}

    def __call__(self, run: str) -> str | None:
        out = run.translate(self.table)
        return out if out != run else None


def _defined(page: str, b: int) -> bool:
    try:
        bytes([b]).decode(page)
        return True
    except UnicodeDecodeError:
        return False


@functools.lru_cache(1)
def ciphers() -> tuple:
    found, seen = [], set()
    for p in CODE_PAGES:
        found.append(_Utf8As(p))
    for a in CODE_PAGES:
        for b in CODE_PAGES:
            if a != b:
                c = _PageAs(a, b)
                k = tuple(sorted(c.table.items()))
                if c.table and k not in seen:
                    seen.add(k)
                    found.append(c)
    found += [_WholeUtf8As(p) for p in (*OTHER_PAGES, *WIDE_PAGES)]
    return tuple(found)


@functools.lru_cache(1)
def repertoire() -> frozenset:
    """The characters with bigrams of their own: those of the code pages. All others share a symbol per category."""
    return frozenset(c for p in CODE_PAGES for c in _byte_chars(p).values())


@functools.lru_cache(100_000)
def symbol(c: str) -> str:
    """A symbol of a bounded alphabet (fewer than 1,000) for any character; '' stands for either end of the text."""
    if c == "":
        return "^"
    if len(c) > 1:  # a symbol already
        return c
    if c < "\x80":
        return c if c.isalpha() else "0" if c.isdigit() else " " if c.isspace() else "."
    return c if c in repertoire() else "" + unicodedata.category(c)


def readings(run: str) -> tuple[tuple[int, str], ...]:
    return _readings(run) if len(run) <= RUN_LIMIT else _readings.__wrapped__(run)


@functools.lru_cache(200_000)
def _readings(run: str) -> tuple[tuple[int, str], ...]:
    """(cipher, decoded) for each cipher that changes the run; of OTHER_PAGES and WIDE_PAGES the first that reads it as no other does."""
    found: dict[int, str] = {}
    for k, c in enumerate(ciphers()):
        d = c(run)
        if d is not None and not (isinstance(c, _WholeUtf8As) and d in found.values()):
            found[k] = d
    return tuple(found.items())


def learnable(left: str, run: str, right: str) -> bool:
    """Whether the run stands at an ASCII letter and has a symbol from outside the pages, so that it may need a learned entry."""
    return len(run) <= LEARNED_LEN and "�" not in run and any(c and c < "\x80" and c.isalpha() for c in (left, right)) and any(c not in repertoire() and c.isalpha() for c in run)


class Model:
    """Bigram counts, smoothed by how many kinds of successors a symbol has (Witten-Bell), and cipher weights."""

    def __init__(self, pairs: dict[tuple[str, str], float], base: dict[int, float], seen: dict[str, float], hits: dict[tuple[str, int], float], table: dict[tuple[str, str], str] | None = None):
        """``base``: each cipher's weight over all sources; ``seen``: runs of a source, ``hits``: those that a cipher explains; ``table``: the
        letter of a source's learned runs."""
        self.pairs, self.base, self.seen, self.hits, self.table = pairs, base, seen, hits, table or {}
        self.pages: dict[str, dict[int, str]] = defaultdict(dict)
        for (source, run), letter in self.table.items():
            if len(run) == 1:
                self.pages[source][ord(run)] = letter
        self.after: dict[str, set] = defaultdict(set)
        self.before: dict[str, set] = defaultdict(set)
        for a, b in pairs:
            # letters of a known script, and the apostrophe within words
            if len(b) == 1 and b > "\x7f" and (b.isalpha() or b == "’"):
                self.after[a].add(b)
            if len(a) == 1 and a > "\x7f" and (a.isalpha() or a == "’"):
                self.before[b].add(a)
        self.first: dict[str, float] = defaultdict(float)
        self.kinds: dict[str, float] = defaultdict(lambda: 1.0)
        second: dict[str, float] = defaultdict(float)
        for (a, b), n in pairs.items():
            self.first[a] += n
            self.kinds[a] += n > 0.5
            second[b] += n
        total = sum(second.values()) + SMOOTH * (len(second) + 1)
        self.unseen = math.log(SMOOTH / total)
        self.alone = {b: (n + SMOOTH) / total for b, n in second.items()}
        self.cache: dict = {}

    def _joint(self, a: str, b: str) -> float:
        return self.pairs.get((a, b), 0.0) + self.kinds[a] * self.alone.get(b, math.exp(self.unseen))

    def log_p(self, left: str, run: str, right: str) -> float:
        """Log probability of the run and what follows, up to a constant of the left context."""
        s = math.log(self._joint(symbol(left), symbol(run[0])))
        for x, y in zip(run, run[1:] + right if right else (*run[1:], "")):
            if x < "\x80" and y < "\x80":  # such pairs aren't counted
                s += math.log(self.alone.get(symbol(y), math.exp(self.unseen)))
                continue
            x, y = symbol(x), symbol(y)
            s += math.log(self._joint(x, y) / (self.first.get(x, 0.0) + self.kinds[x]))
        return s

    def weight(self, source: str, k: int) -> float:
        """A cipher's weight in a source, drawn towards its weight over all sources."""
        base = self.base.get(k, PRIOR)
        return max((self.hits.get((source, k), 0.0) + DRAW * base) / (self.seen.get(source, 0.0) + DRAW), PRIOR / 4)

    def gains(self, left: str, run: str, right: str) -> tuple[tuple[int, str, float], ...]:
        """(cipher, decoded, log-likelihood ratio against the literal reading)."""
        key = (symbol(left), run, symbol(right))
        if key in self.cache:
            return self.cache[key]
        got = readings(run)
        plain = self.log_p(left, run, right) if got else 0.0
        out = tuple((k, d, self.log_p(left, d, right) - plain + ciphers()[k].valid(run, d)) for k, d in got)
        if len(run) <= RUN_LIMIT:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[key] = out
        return out

    def letters(self, source: str, left: str, run: str, right: str, known: dict[str, float] | None) -> list[tuple[str, float, float]]:
        """(letter, weight, log-likelihood ratio) of the letters that a run may stand for in a source: those it is ``known`` for, at first all
        that the bigrams know beside its neighbours."""
        if not learnable(left, run, right) or any(self.weight(source, k) * math.exp(min(60.0, g)) > 1 for k, _, g in self.gains(left, run, right)):
            return []
        if known is None:
            some = (self.after[symbol(left)] | self.before[symbol(right)]) - set(run)
            known = {x: PRIOR / len(some) for x in some}
        plain = self.log_p(left, run, right) if known else 0.0
        return [(x, w, self.log_p(left, x, right) - plain) for x, w in known.items()]

    def learned(self, source: str, left: str, run: str, right: str) -> tuple[str, float] | None:
        """The letters a run stands for by the table, whole or in parts, and their log-likelihood ratio."""
        page = self.pages.get(source, {})
        if (source, run) in self.table:
            out = self.table[source, run]
        elif all(ord(c) in page for c in run):
            out = run.translate(page)
        else:
            ways: list[str | None] = ["", *[None] * len(run)]
            for j in range(1, len(run) + 1):
                for i in range(max(0, j - LEARNED_LEN), j):
                    x = self.table.get((source, run[i:j]))
                    if x and ways[i] is not None:
                        ways[j] = ways[i] + x
                        break
            out = ways[-1]
        return (out, self.log_p(left, out, right) - self.log_p(left, run, right)) if out else None


_MODELS: dict[str, Model] = {}


def _model(shared: Broadcast) -> Model | None:
    """The model of a broadcast, built once in a worker."""
    if shared.value is None:
        return None
    key, *parts = shared.value
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(*parts)
    return _MODELS[key]


def _whole(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(start, left, run, right) of each run of non-ASCII characters; runs beyond RUN_LIMIT only part at U+FFFD, as any other
    cut may fall within a character."""
    for m in RUN.finditer(text):
        for part in re.finditer("[^�]+|�+", m[0]) if m.end() - m.start() > RUN_LIMIT else (re.match("(?s).*", m[0]),):
            i, j = m.start() + part.start(), m.start() + part.end()
            yield i, text[i - 1 : i], text[i:j], text[j : j + 1]


def _pieces(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(start, left, run, right) of each run of non-ASCII characters; runs beyond RUN_LIMIT come in pieces, for
    statistics only."""
    for m in RUN.finditer(text):
        for i in range(m.start(), m.end(), RUN_LIMIT):
            j = min(i + RUN_LIMIT, m.end())
            yield i, text[i - 1 : i], text[i:j], text[j : j + 1]


def _count_bigrams(into: dict, left: str, run: str, right: str, n: float) -> None:
    s = [symbol(left), *map(symbol, run), symbol(right)]
    for p in zip(s, s[1:]):
        into[p] += n


_RUNS = "source string, l string, run string, r string, n long"
_STATS = "kind string, a string, b string, w double"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict = defaultdict(int)
        for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for _, left, run, right in _pieces(t):
                found[s, left and symbol(left), run, right and symbol(right)] += 1
        rows = list(found.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k, _ in rows], pa.string()) for i in range(4)] + [pa.array([n for _, n in rows], pa.int64())], names=["source", "l", "run", "r", "n"]
        )


def _expect(shared: Broadcast, first: bool):
    """The E step over runs, as sums for the M step; ``first``: no letters of runs are known yet."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        pairs: dict = defaultdict(float)
        ciph: dict = defaultdict(float)
        learned: dict = defaultdict(float)
        for batch in batches:
            for s, left, run, right, n, entry in zip(*(c.to_pylist() for c in batch.columns)):
                known = None if first else {e["x"]: e["w"] for e in entry or ()}
                rest = 1.0
                if model is not None and "�" not in run:
                    odds = [(k, d, model.weight(s, k) * math.exp(min(60.0, g))) for k, d, g in model.gains(left, run, right)]
                    table = [(x, w * math.exp(min(60.0, g))) for x, w, g in model.letters(s, left, run, right, known)]
                    total = 1.0 + sum(o for *_, o in odds) + sum(o for _, o in table)
                    rest = 1.0 / total
                    for k, d, o in odds:
                        if o / total > 1e-4:
                            _count_bigrams(pairs, left, d, right, n * o / total)
                            ciph[s, str(k)] += n * o / total
                    for x, o in table:
                        if o / total > 1e-3:
                            _count_bigrams(pairs, left, x, right, n * o / total)
                            learned[f"{s}\t{run}", x] += n * o / total
                    if table:
                        learned[f"{s}\t{run}", "all"] += n
                        learned[f"{s}\t{run}", "contexts"] += 1
                    ciph[s, "all"] += n
                _count_bigrams(pairs, left, run, right, n * rest)
        rows = [("p", a, b, w) for (a, b), w in pairs.items()] + [("c", a, b, w) for (a, b), w in ciph.items()] + [("t", a, b, w) for (a, b), w in learned.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)] + [pa.array([r[3] for r in rows], pa.float64())], names=["kind", "a", "b", "w"])

    return work


def _table(stats: DataFrame) -> DataFrame:
    """The M step of the table, ``(source, run, entry)``: a letter's share in a run's occurrences in a source, drawn towards that over all
    sources. A run has an entry for each letter at most."""
    t = stats.filter("kind = 't'").select(F.expr("substring(a, 1, instr(a, '\t') - 1)").alias("source"), F.expr("substring(a, instr(a, '\t') + 1)").alias("run"), F.col("b").alias("x"), "w")
    every = t.groupBy("run", "x").agg(F.sum("w").alias("e"))
    whole = every.groupBy("run").agg(F.max(F.when(F.col("x") == "all", F.col("e"))).alias("all"), F.max(F.when(F.col("x") == "contexts", F.col("e"))).alias("contexts"))
    letters = every.filter("x not in ('all', 'contexts')").join(whole.filter(F.col("contexts") >= LEARNED_CONTEXTS), "run").select("run", "x", (F.col("e") / F.col("all")).alias("share"))
    here = t.filter("x = 'all'").select("source", "run", F.col("w").alias("n")).join(letters, "run").join(t, ["source", "run", "x"], "left")
    w = here.withColumn("w", (F.coalesce("w", F.lit(0.0)) + 2 * F.col("share")) / (F.col("n") + 2)).filter("w > 1e-3")
    return w.groupBy("source", "run").agg(F.array_sort(F.collect_list(F.struct("x", "w"))).alias("entry"))


def source_key(source: str | None) -> Column:
    """A source without case and surrounding blanks, as a hash."""
    return F.lit("") if source is None else F.xxhash64(F.lower(F.trim(F.coalesce(F.col(source).cast("string"), F.lit(""))))).cast("string")


def learn(docs: DataFrame, text: str, source: str | None, stage: Stage, rounds: int = EM_ROUNDS) -> Broadcast:
    """Fit bigrams, cipher weights and tables over all runs of non-ASCII characters of the corpus. What reaches the driver is at
    most the square of the symbol alphabet, the ciphers that explain runs of each source, and at the end the table's sure entries."""
    spark = docs.sparkSession
    some = docs.filter(F.col(text).rlike(r"[^\x00-\x7F]")).select(source_key(source).alias("source"), F.col(text).alias("text"))
    runs = some.mapInArrow(_extract, _RUNS).groupBy("source", "l", "run", "r").agg(F.sum("n").alias("n"))
    runs = stage.put(runs, "runs")
    none = F.lit(None).cast("array<struct<x:string,w:double>>").alias("entry")
    given, shared, table = runs.select("*", none), spark.sparkContext.broadcast(None), None
    for step in range(rounds + 1):
        stats = stage.put(given.mapInArrow(_expect(shared, step < 2), _STATS).groupBy("kind", "a", "b").agg(F.sum("w").alias("w")), "stats")
        got = stats.filter("kind <> 't'").collect()
        pairs = {(r.a, r.b): r.w for r in got if r.kind == "p"}
        seen = {r.a: r.w for r in got if r.kind == "c" and r.b == "all"}
        hits = {(r.a, int(r.b)): r.w for r in got if r.kind == "c" and r.b != "all"}
        if len(seen) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources; a coarser column is needed")
        base: dict = {}
        if step:
            total, every = sum(seen.values()) or 1.0, defaultdict(float)
            for (_, k), w in hits.items():
                every[k] += w
            base = {k: (every[k] + 100 * PRIOR) / (total + 100) for k in range(len(ciphers()))}
            if not stats.filter("kind = 't'").isEmpty():
                table = stage.put(_table(stats), "table")
            else:
                table = None
            given = runs.join(table, ["source", "run"], "left").select("source", "l", "run", "r", "n", "entry") if table is not None else runs.select("*", none)
        parts = (uuid.uuid4().hex, pairs, base, seen, hits)
        shared = spark.sparkContext.broadcast(parts)
        stage.drop(stats)
    if table is not None:
        best = F.array_max(F.transform("entry", lambda e: F.struct(e["w"].alias("w"), e["x"].alias("x"))))
        sure = table.select("source", "run", best.alias("b")).filter(F.col("b.w") >= LEARNED_WEIGHT).select("source", "run", "b.x").limit(MAX_LEARNED + 1).collect()
        if len(sure) > MAX_LEARNED:
            raise ValueError(f"more than {MAX_LEARNED} learned entries; a coarser source column is needed")
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, *parts[1:], {(r.source, r.run): r.x for r in sure}))
    stage.only()
    return shared


def _unbyte(body: str) -> str | None:
    """The text of a printed byte string's content, or null if the escapes give no UTF-8."""
    try:
        raw = re.sub(rb"\\(x[0-9a-fA-F]{2}|[nrt0\\'\"])", lambda m: bytes([int(m[1][1:], 16)]) if m[1][:1] == b"x" else {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"0": b"\0"}.get(m[1], m[1]), body.encode("utf-8"))
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def judge(text: str, source: str, model: Model) -> tuple[str, str | None, bool] | None:
    """(kind, restored text, whether all of it is restored) of a damaged text, else None."""
    m = BYTES.match(text)
    if m and not re.search(r"(?<!\\)(?:\\\\)*" + m[1], m[2]):
        back = _unbyte(m[2])
        inner = judge(back, source, model) if back is not None else None
        return ("bytes", inner[1] if inner else back, back is not None and (inner is None or inner[2]))
    lost = "�" in text
    kinds: list[str] = []
    seen: set[str] = set()
    used: set[int] = set()
    settled = False
    while text not in seen:
        seen.add(text)
        by: dict = defaultdict(float)
        parts = list(_whole(text))
        options = []
        for i, left, run, right in parts:
            # a row that was read as a page before may have been so again, whatever the cipher's weight
            got = {k: (d, g + (0.0 if k in used and len(d) < len(run) else math.log(model.weight(source, k)))) for k, d, g in model.gains(left, run, right) if "�" not in run}
            if not any(g > 0 for _, g in got.values()) and (more := model.learned(source, left, run, right)) and more[1] > 0:
                got[LEARNED] = more
            options.append(got)
            for k, (_, g) in got.items():
                if g > 0:
                    by[k] += g
        if not by:
            settled = True
            break
        best = max(by, key=lambda k: (by[k], -k))
        out, at = [], 0
        for (i, _, run, _), got in zip(parts, options):
            out.append(text[at:i])
            at = i + len(run)
            # once a row is known to be swapped, a run follows the row's cipher unless that is clearly worse
            k = best if best in got and got[best][1] > -1.0 else max(got, key=lambda x: got[x][1], default=None)
            out.append(got[k][0] if k is not None and (got[k][1] > 0 or k == best and got[k][1] > -1.0) else run)
        text = "".join(out) + text[at:]
        if text in seen:  # nothing more is settled
            break
        used.add(best)
        kinds.append("learned" if best == LEARNED else ciphers()[best].name)
    if not kinds and not lost:
        return None
    # beside learned runs, one that no entry explains may be damaged as well
    unsure = "learned" in kinds and any(learnable(left, run, right) for _, left, run, right in _whole(text))
    return ("+".join(kinds) or "lost", text, settled and not lost and not unsure)


_OUT = "row_id long, kind string, restored string, complete boolean"


def _judge_all(shared: Broadcast):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in batches:
            ids, src, texts = (batch.column(i).to_pylist() for i in range(3))
            rows = [(i, *v) for i, s, t in zip(ids, src, texts) if (v := judge(t, s, model)) is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.bool_())],
                names=["row_id", "kind", "restored", "complete"],
            )

    return work


def repair_encoding(docs: DataFrame, id_col: str, text_col: str, source_col: str | None = None) -> DataFrame:
    """``(row_id, kind, restored, complete)`` of each damaged row: how it was damaged, its text with the damage
    undone as far as it can be, and whether that is all of it. Rows without damage give no row."""
    stage = Stage(docs.sparkSession, "encoding")
    shared = learn(docs, text_col, source_col, stage)
    t = F.col(text_col)
    some = docs.filter(t.rlike(r"[^\x00-\x7F]") | t.rlike(BYTES_JAVA)).select(F.col(id_col).cast("long").alias("row_id"), source_key(source_col).alias("source"), t.alias("text"))
    return some.mapInArrow(_judge_all(shared), _OUT)
