"""Toxicity scores of deobfuscated text.

Writers hide words with look-alike signs, stray signs or blanks between letters and
repeated letters.  That is a noisy channel: each observed sign could have been written
for several intended letters (or for none), at a cost.  Suspect tokens open into a
lattice of intended letters, in which a Viterbi search finds the cheapest path under a
character trigram model of the whole corpus and the channel's costs.  The classifier
sees the restored words: a logistic regression adds up evidence of words and word
beginnings.
"""

from __future__ import annotations

import copy
import hashlib
import math
import re
import string
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from glyphrake.llm.common import LAST_LETTER, LETTER_BITS, MOST_HELD, GramCounts, distinct_grams, gram_key, in_slices, materialize, pieces_of, small_letters, table, unused

#: Signs and the letters that they may stand for: fixed values.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c", "^": "a", "µ": "u", "§": "s", "¢": "c"}
#: Costs in nats: a look-alike, a look-alike left out, another sign left out, a sign kept as it is, a letter of a run left out, a blank left out.
COST_LOOKALIKE, COST_DROPPED, COST_STRAY, COST_KEPT, COST_REPEAT, COST_BLANK = 0.8, 6.0, 1.0, 3.0, 0.6, 0.3
#: At most so many labelled rows with either label are fitted on; the draw follows from the id.
SAMPLE = {1: 5_000, 0: 10_000}
#: Counts of the character model that are sent to tasks at most (the rest is joined), rounds of the fit, ridge on weights, rows that a feature needs, remembered tokens.
MOST_GRAMS, ROUNDS, RIDGE, LEAST_DOCUMENTS, REMEMBERED = 4_000_000, 400, 0.2, 2, 300_000
THRESHOLD = 0.7
#: Lengths of word beginnings that count as features.
BEGINNINGS = (4, 5, 6, 7)
CHARS = 1_000_000


def _letter(char: str) -> int:
    """The code point of a letter in small; 0 for any other sign."""
    return int(small_letters()[ord(char)]) if ord(char) < LAST_LETTER else 0


#: In the place of a gram's first letter: its count stands for the last two letters, the first two, the last one, the middle one.
LAST_TWO, FIRST_TWO, LAST, MIDDLE = range(1 << LETTER_BITS - 1, (1 << LETTER_BITS - 1) + 4)


class Lacking(LookupError):
    """A count is wanted that was not sent along with the model."""


class CharacterModel:
    """Costs (negative log probabilities) of a letter after two others; 0 stands for no letter.

    Probabilities mix trigrams, bigrams and single letters.  keys (sorted) and counts are
    those of trigrams of letters as they are, and of their parts; total is that of all
    trigrams, letters the number of different last ones.  Costs are remembered once taken.

    rarer is the table (key, n) of the counts that are not among keys; None if there are
    no others.  It stays with the driver: a task that needs one of them gets Lacking.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, letters: int, rarer: DataFrame | None = None):
        self.keys, self.counts, self.rarer, self.complete = keys, counts, rarer, rarer is None
        self._total, self._kinds, self._known, self.more = float(total), letters + 1, {}, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rarer": None}

    def completed(self) -> CharacterModel:
        """The model for searches all of whose other counts are put in more first; what is not there either never occurs."""
        out = copy.copy(self)
        out.complete, out._known = True, {}
        return out

    def sent(self, key: int) -> bool:
        at = int(np.searchsorted(self.keys, key))
        return at < len(self.keys) and int(self.keys[at]) == key

    def _of(self, key: int) -> float:
        at = int(np.searchsorted(self.keys, key))
        if at < len(self.keys) and self.keys[at] == key:
            return float(self.counts[at])
        if not self.complete:
            raise Lacking(key)
        return float(self.more.get(key, 0))

    @staticmethod
    def parts(a: int, b: int, c: int) -> tuple[int, ...]:
        """Keys of the counts that the cost of c after a and b is made of."""
        return gram_key(a, b, c), gram_key(FIRST_TWO, a, b), gram_key(LAST_TWO, b, c), gram_key(MIDDLE, 0, b), gram_key(LAST, 0, c)

    def cost(self, a: int, b: int, c: int) -> float:
        key = gram_key(a, b, c)
        found = self._known.get(key)
        if found is None:
            three, first_two, last_two, middle, last = map(self._of, self.parts(a, b, c))
            p1 = (last + 1) / (self._total + self._kinds)
            p2 = (last_two + 20 * p1) / (middle + 20)
            found = -math.log((three + 20 * p2) / (first_two + 20))
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[key] = found
        return found


class Asked:
    """Stands in for a model that is not complete and notes the keys that it lacks.

    A search goes through the same letters whatever they cost, so one round finds all.
    """

    def __init__(self, model: CharacterModel):
        self._model, self._known, self.keys = model, {}, set()

    def cost(self, a: int, b: int, c: int) -> float:
        found = self._known.get((a, b, c))
        if found is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            found = self._known[a, b, c] = tuple(x for x in CharacterModel.parts(a, b, c) if not self._model.sent(x))
        self.keys.update(found)
        return 0.0


def _with_parts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams and their counts, then their parts and theirs."""
    one, two = (1 << LETTER_BITS) - 1, (1 << 2 * LETTER_BITS) - 1
    all_keys, all_counts = [keys], [counts]
    for kind, part in ((LAST_TWO, keys & two), (FIRST_TWO, keys >> LETTER_BITS), (LAST, keys & one), (MIDDLE, (keys >> LETTER_BITS) & one)):
        found, at = np.unique(part, return_inverse=True)
        all_keys.append(found | (kind << 2 * LETTER_BITS))
        all_counts.append(np.bincount(at, weights=counts, minlength=len(found)).astype(np.int64))
    return np.concatenate(all_keys), np.concatenate(all_counts)


def counted(batches: Iterator[pa.RecordBatch], most: int = MOST_HELD) -> Iterator[pa.RecordBatch]:
    """key, n: trigrams of texts and their parts with counts, which a task hands on when it has so many different ones."""
    sums, letters = GramCounts(most), small_letters()

    def out() -> Iterator[pa.RecordBatch]:
        keys, counts = _with_parts(*sums.taken())
        yield from in_slices(pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"]))

    for batch in batches:
        texts = [x or "" for x in batch.column(0).to_pylist()]
        for begin, end in pieces_of(texts, CHARS):
            codes = np.frombuffer("\n\n".join(["", *texts[begin:end], ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
            small = letters[np.minimum(codes, LAST_LETTER - 1)]
            keys, at = distinct_grams(small, slice(None))
            sums.add(keys, np.bincount(at, minlength=len(keys)))
            if sums.full:
                yield from out()
    yield from out()


def character_model(docs: DataFrame) -> CharacterModel:
    """The model from the trigrams of all documents, each with its count.

    The table of counts grows with the corpus and stays where it is.  Tasks get the
    greatest ones, as many as MOST_GRAMS, 16 bytes each; settled() joins the others.
    """

    grams = materialize(docs.select("text").mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "toxic-grams")
    # by the number of binary digits of a count: how many, the sum of whole trigrams, the different last letters
    kind = F.shiftright("key", 2 * LETTER_BITS)
    by_size = grams.groupBy(F.length(F.bin("n")).alias("digits")).agg(F.count("*").alias("grams"), F.sum(F.when(kind < LAST_TWO, F.col("n"))).alias("total"), F.count(F.when(kind == LAST, 1)).alias("letters")).collect()
    digits, held = max((r["digits"] for r in by_size), default=0), 0
    there = {r["digits"]: r["grams"] for r in by_size}
    while digits and held + there.get(digits, 0) <= MOST_GRAMS:
        held += there.get(digits, 0)
        digits -= 1
    # counts of so many digits or fewer stay
    least = 1 << digits
    found = grams.where(F.col("n") >= least).toArrow().sort_by("key")
    return CharacterModel(found.column("key").to_numpy(), found.column("n").to_numpy(), sum(r["total"] or 0 for r in by_size), sum(r["letters"] for r in by_size), grams.where(F.col("n") < least) if digits else None)


#: A letter next to a look-alike, or signs between letters; two equal letters; pieces of up to so many signs with any blanks between them.
_LOOK = re.escape("".join(LOOKALIKES))
_SIGNS = _LOOK + r"._*~#%&=:;,'\"/\\\-"
PIECE = 3
SIGNED = re.compile(rf"[^\W\d_][{_SIGNS}]+[^\W\d_]|[{_LOOK}][^\W\d_]|[^\W\d_][{_LOOK}]")
DOUBLED = re.compile(r"([^\W\d_])\1", re.IGNORECASE)
SPACED = re.compile(rf"(?<!\S)\S{{1,{PIECE}}}(?:\s+\S{{1,{PIECE}}})+(?!\S)")
_SIGN, _RUN = re.compile(f"[{_LOOK}]"), re.compile(r"(.)\1+", re.DOTALL)
TRIMMED = string.punctuation + "¡¿«»„“”‚‘’…–—"
#: Signs around words that stand for no letter, a run of letters, and letters that tell whether an outline can be a wanted one.
_STRAY, _LETTERS, HEAD = "".join(c for c in TRIMMED if c not in LOOKALIKES), re.compile(r"[^\W\d_]+"), 3


def restore(token: str, model: CharacterModel) -> str:
    """The likeliest intended text of a token: letters, and blanks where they are kept.

    A Viterbi search over the lattice of the token's signs; a state is the last two
    letters.  Runs of a letter may stand for one, two or all of them, runs of a look-alike
    for one letter or a letter each.
    """
    runs: list[tuple[str, int]] = []
    for char in token.lower():
        if runs and runs[-1][0] == char:
            runs[-1] = (char, runs[-1][1] + 1)
        else:
            runs.append((char, 1))
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for char, times in runs:
        if char.isalpha():
            options = [(char * k, COST_REPEAT * (times - k)) for k in sorted({1, min(2, times), times})] if times > 1 else [(char, 0.0)]
        elif char == " ":
            options = [("", COST_BLANK), (" ", 0.0)]
        else:
            signs = LOOKALIKES.get(char, "")
            options = [(x, COST_LOOKALIKE) for x in signs]
            if 1 < times <= 3:
                options += [("".join(x), COST_LOOKALIKE * times) for x in product(signs, repeat=times)]
            elif times > 3:
                options += [(x * k, COST_LOOKALIKE * k) for x in signs for k in (2, times)]
            options += [("", COST_DROPPED if options else COST_STRAY), (char * times, COST_KEPT)]
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in states.items():
            for written, extra in options:
                p, q, total = a, b, cost + extra
                for c in written:
                    s = _letter(c)
                    total += model.cost(p, q, s)
                    p, q = q, s
                best = new.get((p, q))
                if best is None or total < best[0]:
                    new[p, q] = (total, (path, written))
        states = new
    path = min(states.items(), key=lambda x: (x[1][0] + model.cost(*x[0], 0), x[0]))[1][1]
    out = []
    while path:
        path, written = path
        out.append(written)
    return "".join(reversed(out))


def _hash(kind: str, word: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}{word}") >> 1


def outline(word: str) -> str:
    """The letters of the word, one for each run: what signs and letters left out can't change."""
    return _RUN.sub(r"\1", word if word.isalpha() else "".join(filter(str.isalpha, word)))


class Reader:
    """Features of texts; remembers what tokens came to.

    With outlines (those of the wanted words and word beginnings) a token is read only where
    a wanted feature can come out of it; no feature is lost by that.
    """

    def __init__(self, model: CharacterModel, wanted: frozenset[int] | None = None, outlines: frozenset[str] | None = None):
        self.model, self.wanted, self.outlines, self.known, self.useless, self.open = model, wanted, outlines, {}, set(), set()
        # beginnings of what is wanted (HEAD letters, or all of them where there are fewer), with the lengths of what begins so
        self.heads: dict[str, list[int]] = {}
        for n, head in sorted({(len(x), x[:HEAD]) for x in outlines or ()}):
            self.heads.setdefault(head, []).append(n)

    def _begins(self, own: str) -> bool:
        """Whether an outline begins as a wanted one does, as far as its first letters tell."""
        return own[:3] in self.heads or own[:2] in self.heads or own[:1] in self.heads

    def _plainly_not(self, token: str) -> bool:
        """Whether the first letters, all plain and no run, already tell that no wanted outline comes."""
        h = token[:HEAD].lower()
        return len(h) == HEAD and h.isalpha() and h[0] != h[1] != h[2] and not self._begins(h)

    def _hopeful(self, letters: str) -> bool:
        if self.outlines is None or _SIGN.search(letters):
            return True
        own = outline(letters.lower())
        for head in (own[:3], own[:2], own[:1]):
            for n in self.heads.get(head, ()):
                if own[:n] in self.outlines:
                    return True
        return False

    def _may_matter(self, token: str) -> bool:
        """Whether a wanted feature can come out of a token without blanks: its leading letters stay as they are, but for runs."""
        if self._plainly_not(token):
            return False
        token = token.lstrip(_STRAY)
        lead = _LETTERS.match(token)
        if lead is None:
            return True
        if not _SIGN.search(token, lead.end()):
            return self._hopeful(token)
        own = outline(lead.group().lower())
        return len(own) < HEAD or self._begins(own)

    def _suspect(self, token: str, bare: str) -> bool:
        return bool(SIGNED.search(token) or DOUBLED.search(token) and self._hopeful(bare))

    def words(self, token: str) -> list[str]:
        """The restored words of a token, or of pieces with blanks between them, trimmed and in small letters."""
        bare = token.strip(TRIMMED)
        if " " in token:
            pieces = token.split()
            starts = range(len(pieces) - 1)
            if self.outlines is not None:
                starts = [i for i in starts if not self._plainly_not("".join(pieces[i : i + HEAD]))]
            found = [restore(token, self.model)] if any(self._hopeful("".join(pieces[i:]).rstrip(TRIMMED)) for i in starts) else []
        else:
            found = [token]
            if self._suspect(token, bare):
                found.append(restore(token, self.model))
                if bare and bare != token and self._suspect(bare, bare):
                    found.append(restore(bare, self.model))
        return sorted({w for x in found for y in x.lower().split() if (w := y.strip(TRIMMED))})

    def features(self, token: str) -> tuple[int, ...]:
        found: list[int] = []
        if self.outlines is not None and " " not in token and not self._may_matter(token):
            return ()
        for word in self.words(token):
            found.append(_hash("=", word))
            found += [_hash("^", word[:n]) for n in BEGINNINGS if len(word) > n]
        return tuple(x for x in found if self.wanted is None or x in self.wanted)

    def tokens(self, text: str) -> set[str]:
        tokens = set(text.split())
        tokens.update(" ".join(m.group(0).split()) for m in SPACED.finditer(text))
        return tokens

    def parted(self, text: str) -> tuple[set[int], set[str]]:
        """Features of the text, and the tokens whose features need counts that the model lacks."""
        known, useless, out = self.known, self.useless, set()
        tokens = self.tokens(text) - useless
        later = tokens & self.open
        for token in tokens - later if later else tokens:
            found = known.get(token)
            if found is None:
                try:
                    found = self.features(token)
                except Lacking:
                    later.add(token)
                    continue
                if not found:
                    useless.add(token)
                    continue
                if len(known) >= REMEMBERED:
                    known.clear()
                known[token] = found
            out.update(found)
        if len(useless) >= REMEMBERED:
            useless.clear()
        self.open |= later
        if len(self.open) >= REMEMBERED:
            self.open.clear()
        return out, later

    def read(self, text: str) -> set[int]:
        """Features of the text, by a complete model."""
        found, later = self.parted(text)
        if later:
            raise Lacking(min(later))
        return found

    def outlined(self, token: str) -> tuple[str, ...]:
        """Outlines of the wanted words and word beginnings of the token."""
        words = self.words(token)
        out = {outline(w) for w in words if _hash("=", w) in self.wanted}
        out |= {outline(w[:n]) for w in words for n in BEGINNINGS if len(w) > n and _hash("^", w[:n]) in self.wanted}
        return tuple(sorted(out - {""}))  # words of signs alone are tokens as well


def settled(tokens: DataFrame, reader: Callable[[], Reader], rarer: DataFrame, features: bool = True) -> DataFrame:
    """(token, found) of the tokens (each once): features, or outlines, by the counts that were not sent as well.

    What a token's search asks for is joined with the table of the rarer counts by plain
    joins, which Spark can split.  Tokens of which nothing comes are left out.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = copy.copy(reader())
        own.model = asked = Asked(own.model)
        for batch in batches:
            keys = []
            for token in batch.column(0).to_pylist():
                asked.keys = set()
                own.words(token)
                keys.append(sorted(asked.keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["token", "keys"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = copy.copy(reader())
        own.model = own.model.completed()
        for batch in batches:
            held = batch.column(1).flatten()
            own.model.more = dict(zip(held.field("key").to_pylist(), held.field("n").to_pylist()))
            names, found = [], []
            for token in batch.column(0).to_pylist():
                if out := own.features(token) if features else own.outlined(token):
                    names.append(token)
                    found.append(out)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.list_(pa.int64() if features else pa.string()))], names=["token", "found"])

    asked = materialize(tokens.distinct().mapInArrow(ask, "token string, keys array<long>"), "toxic-asked")
    known = asked.select("token", F.explode("keys").alias("key")).join(rarer, "key").groupBy("token").agg(F.collect_list(F.struct("key", "n")).alias("known"))
    none = F.array().cast("array<struct<key:bigint,n:bigint>>")
    again = asked.select("token").join(known, "token", "left").select("token", F.coalesce("known", none).alias("known"))
    return again.mapInArrow(answer, f"token string, found array<{'long' if features else 'string'}>")


def held_out(docs: DataFrame):
    """Rows that no label is learned from; a null id counts as an empty string."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """(doc_id, toxic, text) of labelled rows that are not held out: all of a label, or about as many as sample allows.

    An id with both labels counts as toxic; all rows of an id count.  An id is drawn by its
    hash against the share that is wanted, so that the draw is the same each time and its size is bounded.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.encode(F.col("label_id").cast("string"), "UTF-8")) % 3 != 1)
    there = dict(known.groupBy("toxic").count().toArrow().to_pandas().itertuples(index=False, name=None))
    share = F.lit(0.0)
    for label, most in sample.items():
        share = F.when(F.col("toxic") == label, F.lit(min(1.0, most / max(there.get(label, 0), 1)))).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64(F.lit("draw"), "label_id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id"))
    return rows.select("doc_id", "toxic", "text")


class Classifier:
    """Weights of features and a constant; outlines of the words and beginnings that have weights."""

    def __init__(self, weights: dict[int, float], constant: float, outlines: frozenset[str] = frozenset()):
        self.weights, self.constant, self.outlines = weights, constant, outlines

    def score(self, features: set[int]) -> float:
        total = self.constant + sum(self.weights[x] for x in sorted(features))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def fit(sample: DataFrame, model: CharacterModel, rounds: int = ROUNDS) -> Classifier:
    """Logistic regression with weights that are not negative and a ridge.

    Features that go together in copies of one text share the little that is left to
    explain once the words that recur elsewhere have their weight.  Only features that several rows share and that lean to label 1 are gathered, so
    that the driver gets a few numbers per row of the bounded sample.
    """
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, later = map(sorted, reader.parted(text))
                row = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1
                n = len(found) + 1 + len(later)
                features, tokens = [-1, *found] + [None] * len(later), [None] * (n - len(later)) + later
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([toxic] * n, pa.int32()), pa.array(features, pa.int64()), pa.array(tokens, pa.string())], names=["row", "toxic", "feature", "token"])

    rows = sample.select("text", "toxic").mapInArrow(read, "row long, toxic int, feature long, token string")
    if not model.complete:
        rows = materialize(rows, "toxic-tokens")
        open_ = rows.where("token is not null").select("row", "toxic", "token")
        more = open_.join(settled(open_.select("token"), lambda: Reader(shared.value), model.rarer), "token").select("row", "toxic", F.explode("found").alias("feature"))
        rows = rows.where("token is null").select("row", "toxic", "feature").unionByName(more)
    rows = materialize(rows.groupBy("row", "feature").agg(F.max("toxic").alias("toxic")), "toxic-features")
    everyone = rows.where("feature = -1").select("row", "toxic").toArrow()
    ids, y = everyone.column("row").to_numpy(), everyone.column("toxic").to_numpy().astype(float)
    if not len(y) or not y.sum():
        return Classifier({}, -4.0)
    counts = rows.where("feature <> -1").groupBy("feature").agg(F.sum("toxic").alias("ones"), F.count("*").alias("n"))
    leaning = counts.where((F.col("ones") >= LEAST_DOCUMENTS) & (2 * F.col("ones") >= F.col("n")))
    pairs = rows.where("feature <> -1").join(leaning, "feature").select("row", "feature").toArrow()
    order = np.argsort(ids)
    doc = order[np.searchsorted(ids[order], pairs.column("row").to_numpy())]
    names, feature = np.unique(pairs.column("feature").to_numpy(), return_inverse=True)
    everything = _regress(doc, feature, y, len(names), rounds)
    # margins of rows that the weights have not seen tell where to cut; equal texts are one row
    half = np.argsort(np.argsort(ids)) % 2 == 1
    unseen = np.zeros(len(y))
    for fold in (half, ~half):
        own = fold[doc]
        weights, constant = _regress(doc[own], feature[own], y, len(names), rounds, fold)
        unseen += np.where(fold, 0, constant + np.bincount(doc, weights=weights[feature], minlength=len(y)))
    order = np.argsort(-unseen, kind="stable")
    hits = np.cumsum(y[order])
    best = int(np.argmax(2 * hits / (np.arange(1, len(y) + 1) + y.sum())))
    cut = (unseen[order[best]] + unseen[order[min(best + 1, len(y) - 1)]]) / 2
    weights, constant = everything
    # at the cut the score is the threshold
    constant += math.log(THRESHOLD / (1 - THRESHOLD)) - cut
    kept = {int(n): float(w) for n, w in zip(names, weights) if w >= 0.01}
    wanted = sample.sparkSession.sparkContext.broadcast(frozenset(kept))

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, found, later = Reader(shared.value, wanted.value), set(), set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for token in reader.tokens(text) - later:
                    try:
                        found.update(reader.outlined(token))
                    except Lacking:
                        later.add(token)
        yield pa.RecordBatch.from_arrays([pa.array([*sorted(found), *[None] * len(later)], pa.string()), pa.array([*[None] * len(found), *sorted(later)], pa.string())], names=["outline", "token"])

    # every feature that has a weight comes from rows with label 1
    found = sample.where("toxic = 1").select("text").mapInArrow(outlines, "outline string, token string")
    if not model.complete:
        found = materialize(found, "toxic-outlines")
        more = settled(found.where("token is not null").select("token"), lambda: Reader(shared.value, wanted.value), model.rarer, features=False)
        found = found.where("token is null").select("outline").unionByName(more.select(F.explode("found").alias("outline")))
    found = found.select("outline").distinct().toArrow()
    return Classifier(kept, float(constant), frozenset(found.column("outline").to_pylist()))


def _regress(doc: np.ndarray, feature: np.ndarray, y: np.ndarray, features: int, rounds: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and constant of rows (all by default), by accelerated projected gradient steps."""
    use = np.ones(len(y), bool) if rows is None else rows
    rate = y[use].mean() if use.any() else 0.0
    constant, weights = math.log((rate + 1e-4) / (1 - rate + 1e-4)), np.zeros(features)
    # bounds on the curvature along each weight, from the number of features that share a row
    per_row = np.bincount(doc, minlength=len(y))
    reach = 0.25 * np.bincount(feature, weights=(per_row + 1)[doc], minlength=features) + RIDGE
    previous, ahead, pace = weights, weights, 1.0
    for _ in range(rounds if features else 0):
        pull = np.where(use, y - 1 / (1 + np.exp(-(constant + np.bincount(doc, weights=ahead[feature], minlength=len(y))))), 0)
        weights = np.maximum(0, ahead + (np.bincount(feature, weights=pull[doc], minlength=features) - RIDGE * ahead) / reach)
        constant += pull.sum() / (0.25 * (per_row[use] + 1).sum())
        quicker = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead = weights + (pace - 1) / quicker * (weights - previous)
        previous, pace = weights, quicker
    return weights, float(constant)


def score(docs: DataFrame, model: CharacterModel, classifier: Classifier, kept: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all by default) with the score of every whole text as a last column.

    Null texts count as empty: the score of no evidence.  Where the model has counts that
    were not sent, texts that need them are written with what is known of them; the rest
    of their features is joined by token.
    """
    context = docs.sparkSession.sparkContext
    shared, own = context.broadcast(Reader(model, frozenset(classifier.weights), classifier.outlines)), context.broadcast(classifier)
    complete, name, kept = model.complete, unused(docs, "score"), docs.columns if kept is None else kept
    # of a text that is not yet done: features, the tokens that have yet to be read, and what equal texts share
    features, tokens, key, more = (unused(docs, f"_{name}_{x}") for x in ("features", "tokens", "key", "more"))
    schema = StructType([*(docs.schema[c] for c in kept), StructField(name, DoubleType())])
    place, places, width = docs.columns.index("text"), [docs.columns.index(c) for c in kept], len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value  # a worker keeps what the reader remembers
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(place)]
            found = [reader.parted(x) for x in texts]
            columns = [*(batch.column(i) for i in places), pa.array([None if later else own.value.score(x) for x, later in found], pa.float64())]
            if not complete:
                columns.append(pa.array([sorted(x) if later else None for x, later in found], pa.list_(pa.int64())))
                columns.append(pa.array([sorted(later) or None for _, later in found], pa.list_(pa.string())))
                columns.append(pa.array([hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() if later else None for t, (_, later) in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=written.names)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [own.value.score({*x, *y}) for x, y in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(scores, pa.float64())], names=schema.names)

    written = schema
    if complete:
        return docs.mapInArrow(run, schema)
    written = StructType([*schema, StructField(features, ArrayType(LongType())), StructField(tokens, ArrayType(StringType())), StructField(key, StringType())])
    first = materialize(docs.mapInArrow(run, written), "toxic-first")
    open_ = first.where(F.col(tokens).isNotNull())
    asked = open_.select(F.col(key).alias("text_key"), F.explode(tokens).alias("token")).distinct()
    found = asked.join(settled(asked.select("token"), lambda: shared.value, model.rarer), "token").select("text_key", F.explode("found").alias("feature"))
    found = found.groupBy("text_key").agg(F.collect_set("feature").alias(more)).withColumnRenamed("text_key", key)
    again = open_.join(found, key, "left").select(*kept, features, F.coalesce(more, F.array().cast("array<bigint>")))
    return first.where(F.col(tokens).isNull()).select(*kept, name).unionByName(again.mapInArrow(last, schema))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[CharacterModel, Classifier]:
    """The character model of all documents, and a classifier from the labelled sample."""
    model = character_model(docs)
    return model, fit(labelled_sample(docs, labels), model)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns and no others."""
    scored = score(docs, *learn(docs, labels))
    return scored.where(F.col(scored.columns[-1]) < threshold).select(*docs.columns)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Labels are learned from rows that are not held out.  Empty and null texts get the
    score of a text without evidence.  Null ids are scored, never learned from.  Without
    labels of both kinds no text has evidence.  Repeated ids are scored row by row.
    """
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), *learn(docs, labels), kept=["doc_id"])
    return rows.select("doc_id", held_out(rows).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents, learned from labels that are not held out: see toxicity()."""
    return toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
