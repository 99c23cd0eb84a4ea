"""Language identification of mixed-language text.

The script of a word narrows the languages that may claim it.  Each word is scored
under every remaining language by smoothed character trigrams, and a Viterbi search
with a penalty for switching labels the words; runs of one label are spans.  The
document's language is the one with the most letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphrake.llm.common import LAST_LETTER, MOST_HELD, GramCounts, distinct_grams, gathered, in_slices, materialize, pieces_of, small_letters, table

#: Cost of a switch in nats, added to every trigram's count, least share of a script.
SWITCH, SMOOTH, LEAST_SHARE = 12.0, 0.05, 0.002
#: Numbers of the most frequent trigrams (one for each language) that are sent to all tasks, at most.
ENTRIES = 4_000_000
#: Characters scored at a time.
CHARS = 1_000_000
UNKNOWN = "und"
#: First code points of script ranges and the script from there on: fixed values.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"),
    (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "other"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"),
    (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
)
SCRIPT_NAMES = tuple(sorted({name for _, name in SCRIPTS}))


@cache
def _scripts() -> np.ndarray:
    """The number of the script of every code point."""
    out = np.zeros(LAST_LETTER, np.int8)
    starts = [s for s, _ in SCRIPTS]
    for (s, name), e in zip(SCRIPTS, [*starts[1:], LAST_LETTER]):
        out[min(s, LAST_LETTER) : min(e, LAST_LETTER)] = SCRIPT_NAMES.index(name)
    return out


class Words:
    """Runs of letters of some texts.  keys: their different trigrams; gram: the number of every letter's among them."""

    def __init__(self, texts: list[str]):
        lower, script = small_letters(), _scripts()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        small = lower[np.minimum(codes, LAST_LETTER - 1)]
        at = np.flatnonzero(small)
        self.keys, self.gram = distinct_grams(small, at)
        head = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1))[: len(at)])
        self.head, self.letters = head, np.diff(np.concatenate((head, [len(at)])))
        self.first = at[head]
        begin = np.concatenate(([1], 1 + np.cumsum(sizes)))
        self.doc = np.searchsorted(begin, self.first, side="right") - 1
        self.offset = self.first - begin[self.doc]
        self.script = script[codes[self.first]]


def _fold(key: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 3


def held_out(docs: DataFrame) -> Column:
    """Rows that no label is learned from; a null id counts as an empty string."""
    return _fold(F.col("doc_id")) == 1


class Model:
    """Log probabilities of trigrams by language, and the languages of each script.

    keys (sorted) and counts: the most frequent trigrams and how often each language has
    them.  totals: trigrams of each language; kinds: different ones in all.  complete:
    whether there are no others than keys.
    """

    def __init__(self, languages: list[str], keys: np.ndarray, counts: np.ndarray, totals: np.ndarray, kinds: int, scripts: np.ndarray, complete: bool = True):
        self.languages, self.keys, self.complete = languages, keys, complete
        self._norm = np.log(totals + SMOOTH * (kinds + 1))
        # the last row is that of a trigram that was never seen
        self.scores = self.scored(np.concatenate((counts.reshape(len(keys), len(languages)), np.zeros((1, len(languages))))))
        self.claims = scripts >= LEAST_SHARE * scripts.sum(axis=1, keepdims=True).clip(1) if len(languages) else np.zeros((0, len(SCRIPT_NAMES)), bool)
        # a script that no language claims leaves them all
        self.claims |= ~self.claims.any(axis=0)

    def scored(self, counts: np.ndarray) -> np.ndarray:
        return (np.log(counts + SMOOTH) - self._norm).astype(np.float32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each trigram; the last for those not there."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == keys, at, len(self.keys)) if len(self.keys) else np.full(len(keys), 0)

    def score(self, words: Words, more: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Scores of words by language, less that of the best, however long the word; -inf where the script rules a language out.

        more: sorted keys of rarer trigrams and their scores.
        """
        if not len(words.head) or not self.languages:
            return np.zeros((len(words.head), len(self.languages)), np.float32)
        values = self.scores[self.find(words.keys)]
        if more is not None and len(more[0]):
            at = np.minimum(np.searchsorted(more[0], words.keys), len(more[0]) - 1)
            there = more[0][at] == words.keys
            values[there] = more[1][at[there]]
        scores = np.add.reduceat(values[words.gram], words.head, axis=0, dtype=np.float64)
        scores = np.where(self.claims.T[words.script], scores, -np.inf)
        return (scores - scores.max(axis=1, keepdims=True)).astype(np.float32)


def viterbi(scores: np.ndarray, doc: np.ndarray, docs: int, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word: the sum of scores less switch for each change of label.

    Words stand in document order.  All documents advance together, the longest first
    in the arrays, so that a step costs a few array operations whatever their number.
    """
    n, width = scores.shape
    counts = np.bincount(doc, minlength=docs)
    order = np.argsort(-counts, kind="stable")
    start = (np.cumsum(counts) - counts)[order]
    counts = counts[order]
    longest = int(counts[0]) if docs else 0
    alive = np.searchsorted(-counts, -np.arange(1, longest + 1), side="right")
    stays, best_of = np.ones((n, width), bool), np.zeros(n, np.int16)
    value = np.zeros((docs, width))
    for t in range(longest):
        a = alive[t]
        at = start[:a] + t
        if t:
            best = value[:a].argmax(axis=1)
            change = value[np.arange(a), best][:, None] - switch
            stay = value[:a] >= change
            stays[at], best_of[at] = stay, best
            value[:a] = np.maximum(value[:a], change)
        value[:a] += scores[at]
    labels = np.zeros(n, np.int16)
    now = value.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        at = start[: alive[t]] + t
        own = now[: alive[t]]
        labels[at] = own
        now[: alive[t]] = np.where(stays[at, own], own, best_of[at])
    return labels


def counted(batches: Iterator[pa.RecordBatch], most: int = MOST_HELD) -> Iterator[pa.RecordBatch]:
    """lang, key, n: trigrams (letters of a script: keys below 0) of texts with counts, which a task hands on when it has too many."""
    found: dict[str, GramCounts] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, sums in found.items():
            keys, counts = sums.taken()
            yield from in_slices(pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "key", "n"]))

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own, sums = [t for t, x in zip(texts, langs) if x == lang], found.setdefault(lang, GramCounts(most))
            for begin, end in pieces_of(own, CHARS):
                words = Words(own[begin:end])
                sums.add(words.keys, np.bincount(words.gram, minlength=len(words.keys)))
                sums.add(-1 - np.arange(len(SCRIPT_NAMES)), np.bincount(words.script, weights=words.letters, minlength=len(SCRIPT_NAMES)).astype(np.int64))
                # full, or many languages with some each
                if sums.full or sum(x.held for x in found.values()) > 4 * most:
                    yield from out()
    yield from out()


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the table of all trigrams: key, counts (by language in order of name).

    Trigrams of all training rows are counted: text and lang of rows that are not held
    out.  The table grows with the corpus and stays where it is; the driver gets the most
    frequent trigrams, as many as ENTRIES allows, and a few numbers for each language.
    """

    rows = docs.where(~held_out(docs) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    found = materialize(rows.mapInArrow(counted, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")), "language-counts")
    per_script = found.where("key < 0 and n > 0").collect()
    languages = sorted(r["lang"] for r in found.where("key < 0").select("lang").distinct().collect())
    scripts, totals = np.zeros((len(languages), len(SCRIPT_NAMES))), np.zeros(len(languages))
    for r in per_script:
        scripts[languages.index(r["lang"]), -1 - r["key"]] = r["n"]
    # languages without a letter in their texts are not learned
    learned = scripts.sum(axis=1) > 0
    languages, scripts, totals = [x for x, k in zip(languages, learned) if k], scripts[learned], totals[learned]
    counts = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)) for x in languages]
    grams = materialize(found.where("key >= 0").groupBy("key").agg(F.sum("n").alias("n"), F.array(*counts).cast("array<bigint>").alias("counts")), "language-grams")
    for r in found.where("key >= 0").groupBy("lang").agg(F.sum("n").alias("n")).collect():
        totals[languages.index(r["lang"])] = r["n"]
    kinds = grams.count()
    # a trigram with this share of all is sent: there are no more than the inverse
    share = max(len(languages), 1) / ENTRIES
    often = grams.where(F.col("n") >= share * totals.sum()).select("key", "counts").toArrow().sort_by("key")
    matrix = often.column("counts").combine_chunks().flatten().to_numpy().astype(np.float64) if len(often) else np.zeros(0)
    return Model(languages, often.column("key").to_numpy(), matrix, totals, kinds, scripts, len(often) == kinds), grams.select("key", "counts")


def identify(docs: DataFrame, trained: tuple[Model, DataFrame], switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and, if wanted, spans (start and end character, lang) of every document.

    score is the share of the letters that lang_pred has.  Texts that are null or have
    no letter are und with score 0 and no spans; without training rows all are.  Ties go
    to the first language by name.  Repeated rows stay; an empty table gives no rows.

    Documents whose trigrams are all among the frequent ones are labelled where they are.
    The others' rarer trigrams are joined with the table of all trigrams first.
    """
    model, grams = trained
    spark = docs.sparkSession
    shared, width = spark.sparkContext.broadcast(model), len(model.languages)
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<start:long,end:long,lang:string>>" * spans
    later = not model.complete

    def labelled(ids: pa.Array, texts: list[str], more: tuple[np.ndarray, np.ndarray] | None) -> tuple[list[pa.Array], list[np.ndarray]]:
        """The columns of the result, and the rarer trigrams of each document."""
        own = shared.value
        scores, doc, letters, offset = [np.zeros((0, width), np.float32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        rare: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        for begin, end in pieces_of(texts, CHARS if width < 16 else CHARS // 8):
            words = Words(texts[begin:end])
            for all_, x in ((scores, own.score(words, more)), (doc, words.doc + begin), (letters, words.letters), (offset, words.offset)):
                all_.append(x)
            if later and more is None and width:
                unknown = own.find(words.keys) == len(own.keys)
                at = np.flatnonzero(unknown[words.gram])
                if len(at):
                    whose = np.repeat(words.doc, words.letters)[at] + begin
                    for i in np.unique(whose).tolist():
                        rare[i] = np.unique(words.keys[words.gram[at[whose == i]]])
        scores, doc, letters, offset = (np.concatenate(x) for x in (scores, doc, letters, offset))
        if not width:
            doc = letters = np.zeros(0, np.int64)
        labels = viterbi(scores, doc, len(texts), switch) if width else np.zeros(0, np.int16)
        sums = np.bincount(doc * max(width, 1) + labels, weights=letters, minlength=len(texts) * max(width, 1)).reshape(len(texts), -1)
        total, best = sums.sum(axis=1), sums.argmax(axis=1)
        pred = [own.languages[b] if t else UNKNOWN for b, t in zip(best.tolist(), total.tolist())]
        out = [ids, pa.array(pred, pa.string()), pa.array(sums.max(axis=1) / total.clip(1))]
        if spans:
            out.append(pa.array(_spans(doc, labels, offset, letters, len(texts), own.languages), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
        return out, rare

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            out, rare = labelled(batch.column(0), texts, None)
            names = [x.split()[0] for x in ("doc_id", "lang_pred", "score", "spans")][: len(out)]
            if later:
                out += [pa.array([t if len(r) else None for t, r in zip(texts, rare)], pa.string()), pa.array(rare, pa.list_(pa.int64()))]
                names += ["text", "rare"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in gathered(batches):
            held = batch.column(2).flatten()
            keys, at = np.unique(held.field("key").to_numpy(zero_copy_only=False).astype(np.int64), return_index=True)
            counts = held.field("counts").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), width)
            out, _ = labelled(batch.column(0), [x or "" for x in batch.column(1).to_pylist()], (keys, own.scored(counts)))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "spans"][: len(out)])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    if not later:
        return rows.mapInArrow(first, schema)
    found = materialize(rows.mapInArrow(first, schema + ", text string, rare array<long>"), "language-first").withColumn("text_key", F.md5("text"))
    done = found.where("text is null").drop("text", "rare", "text_key")
    open_ = found.where("text is not null").select("doc_id", "text", "text_key", "rare")
    wanted = open_.select("text_key", F.explode("rare").alias("key")).distinct()
    known = materialize(wanted.join(grams, "key").groupBy("text_key").agg(F.collect_list(F.struct("key", "counts")).alias("known")), "language-rare")
    none = F.array().cast("array<struct<key:bigint,counts:array<bigint>>>")
    again = open_.join(known, "text_key", "left").select("doc_id", "text", F.coalesce("known", none).alias("known"))
    return done.unionByName(again.mapInArrow(second, schema))


def _spans(doc: np.ndarray, labels: np.ndarray, offset: np.ndarray, letters: np.ndarray, docs: int, languages: list[str]) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(docs)]
    if len(doc):
        heads = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (labels[1:] != labels[:-1]))))
        lasts = np.concatenate((heads[1:], [len(doc)])) - 1
        for h, e in zip(heads.tolist(), lasts.tolist()):
            out[doc[h]].append({"start": int(offset[h]), "end": int(offset[e] + letters[e]), "lang": languages[labels[h]]})
    return out


def op10_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out: see identify()."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out(found).alias("held_out"), "lang_pred", "score")
