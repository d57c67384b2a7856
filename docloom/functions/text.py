"""Text and path functions, as column expressions unless said otherwise."""

from __future__ import annotations

import re
import unicodedata
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

WINDOW, STEP, MOST_CHUNKS = 200, 170, 40
CHUNK_IDS = 1_000_000  # chunk ids of a file; a text of more windows is an error


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(filename(path), r"[^.](\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def filename_words(path: Column) -> Column:
    """The name with runs of _ - . as one space."""
    return F.regexp_replace(filename(path), r"[_\-.]+", " ")


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/+$", "")


def relative_path(path: Column, root: str) -> Column:
    return F.replace(F.substr(path, F.lit(len(root.rstrip("/\\")) + 2)), F.lit("\\"), F.lit("/"))


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, r"[\\/][^\\/]*$", "")


def breadcrumb(path: Column) -> Column:
    return F.array_join(F.filter(F.split(path, r"[\\/]"), lambda p: p != ""), " > ")


def meta_text(name: Column, path: Column) -> Column:
    """What stands for a file itself in the index: readable stem, name and path."""
    return F.concat_ws(" ", F.translate(F.regexp_replace(name, r"\.[^.]*$", ""), "_-", "  "), name, path)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s]+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def windows(text: Column, size: int = WINDOW, step: int = STEP) -> Column:
    """Overlapping word windows; the last one reaches the end."""

    def cut(w: Column) -> Column:
        last = F.greatest(F.ceil((F.size(w) - F.lit(size)) / F.lit(float(step))), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda p: F.array_join(F.slice(w, p * step + 1, F.lit(size)), " "))

    made = F.transform(F.filter(F.array(words(text)), lambda w: F.size(w) > 0), cut)  # an array of one: the words are split once, not for each window
    return F.coalesce(F.get(made, 0), F.array().cast("array<string>"))


def index_chunks(files: DataFrame, documents: DataFrame) -> DataFrame:
    """chunk_id, file_id, chunk_index, text: the meta chunk of each file, then its word windows; at most CHUNK_IDS of a file."""
    meta = files.select(
        (F.col("file_id") * CHUNK_IDS).alias("chunk_id"), "file_id", F.lit(0).alias("chunk_index"), meta_text(F.col("filename"), F.col("path")).alias("text")
    )
    cut = documents.select(F.col("doc_id").alias("file_id"), F.posexplode(windows(F.col("text"))).alias("p", "text"))
    fits = F.when(F.col("p") + 1 < CHUNK_IDS, F.col("file_id") * CHUNK_IDS + F.col("p") + 1)
    chunk = F.coalesce(fits, F.raise_error(F.concat(F.lit("too many chunks in file "), F.col("file_id").cast("string"))).cast("long"))
    return meta.union(cut.select(chunk, "file_id", (F.col("p") + 1).cast("int"), "text"))


def file_of(chunk_id: Column) -> Column:
    """The file of a chunk of `index_chunks`."""
    return F.floor(chunk_id / CHUNK_IDS).cast("long")


def spread(rows: DataFrame, group: str, order: str, most: int = MOST_CHUNKS) -> DataFrame:
    """At most `most` rows of each group, evenly spaced in their order.

    Row i of n stays if it is floor(k * n / most) for some k below `most`.
    """
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(group))
    i = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    rows = rows.withColumns({"_n": n, "_i": i}).withColumn("_k", F.ceil(F.col("_i") * F.lit(float(most)) / F.col("_n")))
    keep = (F.col("_n") <= most) | ((F.col("_k") < most) & (F.floor(F.col("_k") * F.col("_n") / F.lit(float(most))) == F.col("_i")))
    return rows.where(keep).drop("_n", "_i", "_k")


def normal_tags(tags: Column) -> Column:
    """Lower-case tags of a-z, 0-9 and -, each once, in their order."""
    clean = F.transform(tags, lambda t: F.regexp_replace(F.replace(F.regexp_replace(F.lower(F.trim(t)), r"[^a-z0-9\- ]+", ""), F.lit(" "), F.lit("-")), "^-+|-+$", ""))
    return F.array_distinct(F.filter(clean, lambda t: t.isNotNull() & (t != "")))


def category_tags(category: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(category, F.lit("")), "/"), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    return normal_tags(F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("other"))))


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB, at most two decimals."""
    unit = F.greatest(F.lit(0), F.least(F.lit(4), F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) / 10 + 1e-12))).cast("int")
    value = F.format_string("%.2f", F.round(size / F.pow(F.lit(1024.0), unit), 2))
    short = F.regexp_replace(F.regexp_replace(value, "0+$", ""), "[.]$", "")
    return F.concat_ws(" ", short, F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), unit + 1))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}._\- ]", "")


def highlight(text: Column, query: str) -> Column:
    """Marks the words of a query, whatever their case."""
    parts = sorted({w for w in query.split() if w}, key=lambda w: (-len(w), w))
    if not parts:
        return text
    pattern = "|".join(re.escape(w) for w in parts)
    return F.regexp_replace(text, f"(?i)({pattern})", "<mark>$1</mark>")


def log_prefix(message: Column) -> Column:
    return F.regexp_extract(message, r"^\[(.*?)\]", 1)


# Words that set the level of a message.
WARNING_WORDS = ("warning", "warn", "deprecated", "timeout", "retrying", "skipping")
SUCCESS_WORDS = ("✅", "done", "success", "complete", "[ok]", "healthy", "ready", "loaded", "downloaded")


def _any_of(value: Column, words: tuple[str, ...]) -> Column:
    return value.rlike("|".join(re.escape(w) for w in words))


def log_level(message: Column, is_error: Column | None = None) -> Column:
    """error (flagged), warning, success or info, from the message."""
    low = F.lower(message)
    flagged = is_error if is_error is not None else F.lit(False)
    return F.when(flagged, "error").when(_any_of(low, WARNING_WORDS), "warning").when(_any_of(low, SUCCESS_WORDS), "success").otherwise("info")


def csv_list(tags: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


# Sentence-aware chunks carry words from one chunk to the next, so they are made in Python.

_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n{2,}")


def chunk_spans(ends: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Word spans of the chunks of a text whose sentences end at the given words.

    A chunk closes before the sentence that would overfill it; the next one opens
    `overlap` words earlier. Sentences too long for a chunk are cut in windows.
    """
    spans, first, begin = [], 0, 0
    for end in ends:
        if begin > first and end - first > size:
            spans.append((first, begin))
            first = max(first, begin - overlap)
        while end - first > size:
            spans.append((first, first + size))
            first += max(size - overlap, 1)
        begin = end
    return [*spans, (first, begin)] if first < begin else spans


def sentence_chunks(text: str | None, size: int = 1000, overlap: int = 150, most: int = MOST_CHUNKS) -> list[str]:
    """Chunks of at most `size` words that end with sentences where they can; at most `most`, evenly spaced."""
    sentences = [s.split() for s in _SENTENCE.split((text or "").strip())]
    every = [w for s in sentences for w in s]
    spans = chunk_spans(list(accumulate(len(s) for s in sentences if s)), size, overlap)
    out = [" ".join(every[a:b]) for a, b in spans]
    if len(out) > 1 and out[-1] == out[-2]:
        out.pop()
    share = len(out) / most
    return out if share <= 1 else [out[int(k * share)] for k in range(most)]


@arrow_udf(ArrayType(StringType()))
def chunk_text(text: pa.Array) -> pa.Array:
    return pa.array([sentence_chunks(t) for t in text.to_pylist()], pa.list_(pa.string()))


@arrow_udf(ArrayType(StringType()))
def chat_chunk_text(text: pa.Array) -> pa.Array:
    return pa.array([sentence_chunks(t, 900, 120) for t in text.to_pylist()], pa.list_(pa.string()))


# Keyword index terms: case and diacritics folded, then the suffix rules of Porter (1980).

_TERM = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    return c not in "aeiou" and (c != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(w: str) -> int:
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


# The suffix tables of the published algorithm.
_STEP2 = "ational ate|tional tion|enci ence|anci ance|izer ize|abli able|alli al|entli ent|eli e|ousli ous|ization ize|ation ate|ator ate|alism al|iveness ive|fulness ful|ousness ous|aliti al|iviti ive|biliti ble"
_STEP3 = "icate ic|ative |alize al|iciti ic|ical ic|ful |ness "
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _swap(w: str, table: str) -> str:
    rules = sorted((r.split(" ") for r in table.split("|")), key=lambda r: -len(r[0]))
    for end, new in rules:
        if w.endswith(end):
            return w[: -len(end)] + new if _measure(w[: -len(end)]) > 0 else w
    return w


def porter(w: str) -> str:
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and _vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif _double(cut) and cut[-1] not in "lsz":
            w = cut[:-1]
        else:
            w = cut + "e" if _measure(cut) == 1 and _cvc(cut) else cut
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2), _STEP3)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if _measure(w) > 1 and _double(w) and w.endswith("l") else w


@arrow_udf(ArrayType(StringType()))
def keyword_terms(text: pa.Array) -> pa.Array:
    seen: dict[str, str] = {}

    def stem_of(t: str) -> str:
        if t not in seen:
            seen[t] = porter(t)
        return seen[t]

    return pa.array([[stem_of(t) for t in _TERM.findall(fold(x or ""))] for x in text.to_pylist()], pa.list_(pa.string()))
