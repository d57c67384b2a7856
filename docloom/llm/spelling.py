"""Spelling variants: words that differ by one letter, found with forward and backward minimal automata.

Of two words at distance one, the longer with its error taken away or changed,
either the first half stands unchanged in both or the last half does. So each word
is looked up twice: its first half is matched exactly in an automaton of the
words, its last half in an automaton of the reversed words, and the rest is
completed with one error. Automata are minimal and acyclic; every transition knows
how many words come before it, so a path gives the word's number without a table
of words in it.

Spark deals the words by the half that must match: a bucket holds the words of one
length and half, and those that ask for it (of this length for a changed letter,
one longer for a dropped one). A task builds the automata of some whole buckets at
a time (CHUNK words) and streams the questions through them. A bucket of more than
LIMIT rows is dealt out further by its words, and its questions go to each part, so
a half that a third of all words share loads no single task. What a task finds is
summed by word before it is shuffled: pairs are never emitted.

Defined cases: null texts and texts without words add nothing; texts of any length
are read whole; a null id counts as an empty one; repeated rows count again; of
near words of equal count the smallest in code-point order is the form; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrowtext import column
from docloom.llm.common import Tables, checkpoint, map_arrow

LETTERS, LEAST_LENGTH, LEAST_COUNT, TIMES = "A-Za-zÀ-ÿ", 6, 5, 5
CHUNK, LIMIT, HELD = 50_000, 100_000, 200_000
BROADCAST_BUCKETS = 100_000


def count_words(docs: DataFrame, slips: int | None = None, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): maximal runs of letters of at least `least` code points, A-Z lower-cased, and how often they occur.

    slips: where this divides the CRC-32 of `<doc_id>:<run>`, the run loses the code
    point at that CRC modulo its length.
    """
    find = re.compile(f"[{LETTERS}]{{{least},}}")

    def run(batches):
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), column(batch, "text", lower=True).to_pylist(), strict=True):
                if slips is None:
                    held.update(find.findall(text))
                    continue
                begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(find.findall(text)).items():
                    h = zlib.crc32(word.encode(), begun)
                    if h % slips == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
            if len(held) >= HELD:
                yield rows()
        if held:
            yield rows()

    found = map_arrow(docs.select("doc_id", "text"), run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; number i is the word's place among them.

    A state is a dict of letter: (state, words before this transition); `final` says
    whether a word ends there.
    """

    def __init__(self, words: Iterable[str]):
        self.next: list[dict] = [{}]
        self.final, self.count = [False], [0]
        self._same: dict[tuple, int] = {}
        self._free: list[int] = []
        path: list[tuple[int, str]] = []  # the states of the last word that aren't settled, and the letter that leaves each
        last = ""
        for w in words:
            shared, most = 0, min(len(w), len(last))
            while shared < most and w[shared] == last[shared]:
                shared += 1
            end = self._settle(path, shared)
            for c in w[shared:]:
                path.append((end, c))
                end = self._new()
            self.final[end] = True
            path.append((end, ""))
            last = w
        self._settle(path, 0)
        self._number(0)

    def _new(self) -> int:
        if self._free:
            k = self._free.pop()
            self.next[k], self.final[k] = {}, False
            return k
        self.next.append({})
        self.final.append(False)
        self.count.append(0)
        return len(self.next) - 1

    def _settle(self, path: list[tuple[int, str]], shared: int) -> int:
        """States beyond the shared ones are merged with equal ones; gives the state where the next word leaves."""
        if not path:
            return 0
        child = path.pop()[0]
        while len(path) > shared:
            state, c = path.pop()
            self.next[state][c] = self._merged(child)
            child = state
        return child

    def _merged(self, k: int) -> int:
        key = (self.final[k], *self.next[k].items())
        held = self._same.setdefault(key, k)
        if held == k:
            self._number(k)
        else:
            self._free.append(k)
        return held

    def _number(self, k: int) -> None:
        before = int(self.final[k])
        for c, child in self.next[k].items():
            self.next[k][c] = child, before
            before += self.count[child]
        self.count[k] = before

    def near(self, word: str, half: int, size: int) -> set[int]:
        """Numbers of the words of `size` letters that share the first `half` letters of this one and differ by one in the rest.

        size: as many letters as the word has (one is changed), or one less (one is dropped).
        """
        following, final = self.next, self.final
        state = number = 0
        for c in word[:half]:
            step = following[state].get(c)
            if step is None:
                return set()
            state, number = step[0], number + step[1]
        out = set()
        changed = size == len(word)
        for i in range(half, len(word)):
            own = following[state]
            starts = [s for c, s in own.items() if c != word[i]] if changed else [(state, 0)]
            for at, n in starts:
                for c in word[i + 1 :]:
                    step = following[at].get(c)
                    if step is None:
                        break
                    at, n = step[0], n + step[1]
                else:
                    if final[at]:
                        out.add(number + n)
            step = own.get(word[i])
            if step is None:
                break
            state, number = step[0], number + step[1]
        return out


class Buckets:
    """Automata of some whole buckets, and what their questions have found, by word."""

    def __init__(self):
        self.found: dict[str, list] = {}  # word: near words, count and text of the best
        self.clear()

    def clear(self) -> None:
        self.held: tuple[list, list] = ([], [])
        self.asked: list[tuple] = []
        self.built: list[tuple[Automaton, list]] | None = None

    def _build(self) -> None:
        """For each side the automaton and (word, n, part) by number."""
        self.built = []
        for side, rows in enumerate(self.held):
            rows.sort(key=lambda r: r[0][::-1] if side else r[0])
            self.built.append((Automaton(r[0][::-1] if side else r[0] for r in rows), rows))

    def _add(self, word: str, near: str, n: int) -> None:
        own = self.found.setdefault(word, [0, -1, ""])
        own[0] += 1
        if n > own[1] or n == own[1] and near < own[2]:
            own[1:] = n, near

    def answer(self) -> None:
        if self.built is None:
            self._build()
        for side, size, part, word, n in self.asked:
            automaton, rows = self.built[side]
            first = size // 2
            numbers = automaton.near(word[::-1], size - first, size) if side else automaton.near(word, first, size)
            for k in numbers:
                near, near_n, near_part = rows[k]
                # Both sides may drop the letter in the middle: the forward one has it.
                if near_part != part or side and size < len(word) and near[:first] == word[:first]:
                    continue
                self._add(word, near, near_n)
                if size < len(word):
                    self._add(near, word, n)
        self.asked = []


def _answered(rows: Iterator[tuple], chunk: int = CHUNK) -> Iterator[dict[str, list]]:
    """What is found in rows (side, size, half, part, held, asks, word, n), sorted by bucket, held words first."""
    own, bucket = Buckets(), None
    for side, size, half, part, held, asks, word, n in rows:
        if (side, size, half, part) != bucket:
            bucket = side, size, half, part
            if len(own.held[0]) + len(own.held[1]) >= chunk:
                own.answer()
                own.clear()
                yield own.found
                own.found = {}
        if held:
            own.held[side].append((word, n, part))
            own.built = None
        if asks:
            own.asked.append((side, size, part, word, n))
            if not held and len(own.asked) >= chunk:  # the bucket's own words are all here by now
                own.answer()
                yield own.found
                own.found = {}
    own.answer()
    yield own.found


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, n_near and best (struct of -n and word) of each word (word, n) that has near ones."""
    size = F.length("word")
    first = lambda s: F.floor(s / 2).cast("int")

    def row(side: int, s, held: bool):
        half = F.left(F.col("word"), first(s)) if side == 0 else F.right(F.col("word"), s - first(s))
        return F.struct(F.lit(side).alias("side"), s.alias("size"), half.alias("half"), F.lit(held).alias("held"))

    keyed = words.select("word", "n", F.inline(F.array(*[row(side, s, held) for side in (0, 1) for s, held in ((size, True), (size - 1, False))])))
    counted = checkpoint(keyed.groupBy("side", "size", "half").agg(F.count("*").alias("rows")).where(F.col("rows") > limit))
    large = counted.count()
    if large:
        counted = counted.select("side", "size", "half", F.ceil(F.col("rows") / limit).cast("int").alias("parts"))
        keyed = keyed.join(F.broadcast(counted) if large <= BROADCAST_BUCKETS else counted, ["side", "size", "half"], "left")
        own = F.pmod(F.xxhash64("word"), F.col("parts").cast("long")).cast("int")
        kind = lambda part, held, asks: F.struct(part.cast("int").alias("part"), F.lit(held).alias("held"), F.lit(asks).alias("asks"))
        asking = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: kind(k, False, True))
        split = F.concat(F.when(F.col("held"), F.array(kind(own, True, False))).otherwise(F.array().cast("array<struct<part:int,held:boolean,asks:boolean>>")), asking)
        whole = F.array(F.struct(F.lit(0).alias("part"), F.col("held").alias("held"), F.lit(True).alias("asks")))
        keyed = keyed.select("side", "size", "half", "word", "n", F.inline(F.when(F.col("parts").isNull(), whole).otherwise(split)))
    else:
        keyed = keyed.select("side", "size", "half", "word", "n", F.lit(0).alias("part"), "held", F.lit(True).alias("asks"))
    bucket = ["side", "size", "half", "part"]
    dealt = keyed.select(*bucket, "held", "asks", "word", "n").repartition(*bucket).sortWithinPartitions(*bucket, F.desc("held"))

    def run(batches):
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for found in _answered(rows):
            cells = [(word, n, -best, near) for word, (n, best, near) in found.items()]
            for at in range(0, len(cells), 10_000):
                part = zip(*cells[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "less", "near"])

    found = map_arrow(dealt, run, "word string, n_near long, less long, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))


def group_variants(words: DataFrame, times: int = TIMES, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word (word, n).

    A word's form is its near word of largest n, if that is at least `times` its own;
    its root is where the forms end. A step of the forms multiplies n, so their
    chains are short and doubling settles them in a few rounds.
    """
    with Tables(words.sparkSession, "spelling") as tables:
        words = tables.put(words)
        best = near_words(words, limit)
        judged = tables.put(
            words.join(best, "word", "left").select(
                "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                *[F.when(-F.col("best.less") >= times * F.col("n"), x).alias(name) for x, name in ((F.col("best.near"), "form"), (-F.col("best.less"), "form_n"))],
            )
        )
        roots = tables.put(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
        while True:
            further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
            stepped = tables.put(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            tables.drop(roots)
            roots = stepped
            if roots.where("moved").isEmpty():
                break
        out = judged.join(roots.select("word", "root"), "word", "left")
        return checkpoint(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def variants(docs: DataFrame, slips: int | None = None, least_count: int = LEAST_COUNT) -> DataFrame:
    """The variants of all words of the documents (doc_id, text) that occur at least `least_count` times."""
    return group_variants(count_words(docs, slips).where(F.col("n") >= least_count))
