"""Toxicity scores: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

The features are densities of lexicon words (plain, and found only after undoing obfuscation), the share of
hits near a second-person word, capitals, punctuation and obfuscation rates.  One lexicon is fixed below;
another is learned from the training labels: words and stems
with the log odds of standing in toxic text.  Both are held
as 64-bit word hashes and looked up for a whole Arrow batch at once.

Only the model is fitted on a sample: SAMPLE labelled rows at most, chosen by a hash of their doc_id, none
held out (crc32(doc_id) mod 5 = 0).  Every document is scored over its whole text.

Defined cases: a null text counts as empty, and an empty text gets the score of its features (all 0); a null
doc_id is not held out; null labels are passed over, and a doc_id labelled twice counts as toxic if either
says so; without labels every score is 0; rows that repeat a doc_id are scored each; texts are scored whole, however
long, and alike wherever a table is cut into batches; a score of exactly one half counts as toxic; an empty table gives
no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvatica.llm.boosting import Boosted, boost
from sylvatica.llm.storage import settle, small_batches, text_or_empty
from sylvatica.llm.words import LOWER, distinct, inverse_power, mix, power, slices, words

SAMPLE = 12_000
FOLDS = 5
#: The learned lexicon: at most LEARNED words and stems out of CANDIDATES, each in at least MIN_TEXTS toxic texts of the
#: sample, whose odds in toxic text are LIFT times those in other text or more, by MIN_Z standard errors or more.
LEARNED = 512
CANDIDATES = 8_192
MIN_TEXTS = 4
LIFT = 4.0
MIN_Z = 4.0
#: Lengths of stems in bytes; the first is the head by which words are sifted.
STEMS = (4, 5, 6, 7, 8, 9)
#: Parts of the sample: a text's features for training come from a lexicon learned on the other parts.
PARTS = 4
NEAR = 3
#: From so many toxic texts on, the calibration uses a part of the sample that the trees do not see.
CALIBRATE_APART = 80

#: Abusive words in the four languages of the corpus; none is an ordinary word of another of them.
ABUSE = """
idiot idiots moron morons stupid dumb loser losers clown clowns scum trash garbage worthless pathetic disgusting
imbecile bastard bitch bitches asshole jerk crap shit shitty bullshit fuck fucking fucker dumbass
retard retarded ugly filthy vermin
dumm dummkopf blöd arschloch scheiße scheisse hure wichser versager abschaum hässlich widerlich ekelhaft trottel
idiote crétin connard connasse salope merde imbécile abruti débile dégueulasse
estúpido idiota imbécil gilipollas cabrón mierda asqueroso patético escoria payaso
""".split()

#: Second-person words.
SECOND_PERSON = """
you your yours yourself u ur you're youre thou thee du dich dir dein deine deinen euch ihr euer sie ihnen
tu te toi ton ta tes vous votre vos toi-même tú ti tuyo tuya vos usted ustedes vosotros vuestro
""".split()

#: Characters that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}

FEATURES = (
    "abuse_density", "abuse_count", "learned_density", "learned_count", "learned_sum", "learned_best", "hidden_density", "near_second_person", "second_person_density",
    "upper_share", "shouted_words", "exclamations", "questions", "repeated_marks", "symbol_share", "digit_in_word", "masked_words", "words", "abuse_spread",
)

_PLAIN = np.zeros(256, np.uint64)
_PLAIN[:] = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FOLD = LOWER.copy()
for _sign, _letter in LEET.items():
    _FOLD[ord(_sign)] = ord(_letter)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KEPT = _LETTER.copy()
_KEPT[[ord(c) for c in LEET]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@\\^_|~"]] = True


def prefix_sums(value: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Sums of a polynomial over the kept bytes; ``place`` is each byte's rank among them."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value * power(int(place[-1]) + 2)[place], out=total[1:])
    return total


def run_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Hashes of byte runs whose first kept byte has the given rank."""
    if not len(start):
        return np.zeros(0, np.uint64)
    return mix((sums[end] - sums[start]) * inverse_power(int(rank.max()) + 1)[rank])


def _member(value: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(value), bool)
    at = np.minimum(np.searchsorted(table, value), len(table) - 1)
    return table[at] == value


def letters_hash(word: str) -> int:
    """The hash of a word's letters, as ``Profile`` gives it."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(Profile(raw, np.array([0, len(raw)])).letters[0])


def fixed_lexicon(entries: list[str]) -> np.ndarray:
    return np.unique(np.array([letters_hash(w) for w in entries], np.uint64))


@dataclass
class Lexicon:
    """Learned words and stems: hashes in order, the log odds of each, and a sieve of their heads."""

    units: np.ndarray
    odds: np.ndarray
    heads: np.ndarray  # booleans by the low 16 bits of the head's hash

    @staticmethod
    def of(units: np.ndarray, odds: np.ndarray, heads: np.ndarray) -> Lexicon:
        order = np.argsort(units)
        sieve = np.zeros(1 << 16, bool)
        sieve[(heads & np.uint64(0xFFFF)).astype(np.int64)] = True
        return Lexicon(units[order], odds[order], sieve)

    @staticmethod
    def empty() -> Lexicon:
        return Lexicon.of(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64))

    def look_up(self, value: np.ndarray) -> np.ndarray:
        """The log odds of each hash, 0 for one that was not learned."""
        if not len(self.units):
            return np.zeros(len(value))
        at = np.minimum(np.searchsorted(self.units, value), len(self.units) - 1)
        return np.where(self.units[at] == value, self.odds[at], 0.0)


class Profile:
    """The words of a run of texts with hashes of their letters: plain, with obfuscation undone, and of their
    stems, the first letters of words that are longer."""

    def __init__(self, buffer: np.ndarray, offsets: np.ndarray) -> None:
        self.found = found = words(buffer, offsets)
        self.start, end = found.start, found.end
        if not len(end):
            self.letters = self.folded = self.count = np.zeros(0, np.uint64)
            return
        keep = _LETTER[buffer]
        self.place = np.cumsum(keep) - keep
        value = np.where(keep, _PLAIN[LOWER[buffer]], np.uint64(0))
        self.sums = prefix_sums(value, self.place)
        self.where = np.append(np.flatnonzero(keep), len(buffer))
        self.first = self.place[self.start]
        self.count = np.append(self.place, self.place[-1] + keep[-1])[end] - self.first
        self.letters = run_hashes(self.sums, self.start, end, self.first)
        kept = _KEPT[buffer]
        place = np.cumsum(kept) - kept
        odd = np.flatnonzero(np.append(place, place[-1] + kept[-1])[end] - place[self.start] != self.count)
        self.folded = self.letters.copy()  # words without a sign that stands for a letter are the same
        self.folded[odd] = run_hashes(prefix_sums(np.where(kept, _PLAIN[_FOLD[buffer]], np.uint64(0)), place), self.start[odd], end[odd], place[self.start[odd]])

    def stem(self, k: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, hash) of the first k letters of those words in ``of`` that are longer."""
        long = of[self.count[of] > k]
        end = self.where[self.first[long] + k - 1] + 1
        return long, mix(run_hashes(self.sums, self.start[long], end, self.first[long]) + np.uint64(k))

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the word, hash, hash of its head) of all words and all stems; a short word is its own head."""
        every = np.arange(len(self.letters))
        if not len(every):
            return every, self.letters, self.letters
        head = self.letters.copy()
        at, value = self.stem(STEMS[0], every)
        head[at] = value
        parts = [(every, self.letters), (at, value), *[self.stem(k, every) for k in STEMS[1:]]]
        index = np.concatenate([i for i, _ in parts])
        return index, np.concatenate([h for _, h in parts]), head[index]

    def odds(self, lexicon: Lexicon) -> np.ndarray:
        """The largest log odds of each word and its stems.  Words whose head no entry has are passed over."""
        every = np.arange(len(self.letters))
        out = np.zeros(len(every))
        if not len(every) or not len(lexicon.units):
            return out
        head = self.letters.copy()
        at, value = self.stem(STEMS[0], every)
        head[at] = value
        some = np.flatnonzero(lexicon.heads[(head & np.uint64(0xFFFF)).astype(np.int64)])
        out[some] = lexicon.look_up(self.letters[some])
        for k in STEMS:
            at, value = self.stem(k, some)
            out[at] = np.maximum(out[at], lexicon.look_up(value))
        return out


def features(buffer: np.ndarray, offsets: np.ndarray, learned: Lexicon, abuse: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    p = Profile(buffer, offsets)
    found, n = p.found, len(offsets) - 1
    text, count = found.text, found.count().astype(float)
    per_word = 1 / np.maximum(count, 1)
    size = np.maximum(np.diff(offsets), 1).astype(float)

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.bincount(text[mask], minlength=n).astype(float)

    def per_byte(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    plain = _member(p.letters, abuse)
    odds = p.odds(learned)
    taught = odds > 0
    learned_sum = np.bincount(text, odds, minlength=n) if len(text) else np.zeros(n)
    learned_best = np.zeros(n)
    np.maximum.at(learned_best, text[taught], odds[taught])
    odd = np.flatnonzero(p.folded != p.letters)
    hidden = np.zeros(len(text), bool)
    hidden[odd] = (_member(p.folded[odd], abuse) | (learned.look_up(p.folded[odd]) > 0)) & ~plain[odd] & ~taught[odd]
    hit = plain | taught | hidden
    person = _member(p.letters, second)
    near = np.zeros(len(text), bool)
    for step in range(1, NEAR + 1):
        if len(text) > step:
            same = text[step:] == text[:-step]
            near[step:] |= hit[step:] & person[:-step] & same
            near[:-step] |= hit[:-step] & person[step:] & same
    upper, digit, symbol = _UPPER[buffer], _DIGIT[buffer], _SYMBOL[buffer]
    sums = {k: np.concatenate(([0], np.cumsum(v))) for k, v in (("upper", upper), ("digit", digit), ("star", buffer == 42), ("letter", _LETTER[buffer]))}
    inside = {k: v[found.end] - v[found.start] for k, v in sums.items()}
    length = found.end - found.start
    mark = (buffer == 33) | (buffer == 63)
    doubled = np.zeros(len(buffer), bool)
    doubled[1:] = mark[1:] & mark[:-1]
    doubled[offsets[:-1][offsets[:-1] < len(buffer)]] = False  # not with the mark that ends the text before
    hits = per_text(hit)
    last = np.zeros(n)
    if len(text):
        first_word = np.concatenate(([0], np.cumsum(count)))[:-1]
        place = np.arange(len(text)) - first_word[text]
        np.maximum.at(last, text[hit], place[hit] + 1)
    letters = np.maximum(per_byte(_LETTER[buffer]), 1)
    columns = [
        per_text(plain) * per_word, per_text(plain), learned_sum * per_word, per_text(taught), learned_sum, learned_best, per_text(hidden) * per_word,
        per_text(near) / np.maximum(hits, 1), per_text(person) * per_word,
        per_byte(upper) / letters, per_text((inside["upper"] == length) & (length > 2)) * per_word,
        per_byte(buffer == 33) / size, per_byte(buffer == 63) / size, per_byte(doubled) / size, per_byte(symbol) / size,
        per_text((inside["digit"] > 0) & (inside["letter"] > 1)) * per_word, per_text((inside["star"] > 0) & (inside["letter"] > 0)) * per_word,
        np.log1p(count), last * per_word,
    ]
    return np.stack(columns, axis=1)


def held_out(identifier: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(identifier).cast("string")) % FOLDS == 0, F.lit(False))


def training_labels(labels: DataFrame, sample: int = SAMPLE, identifier: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(doc_id, label) of at most ``sample`` rows that are not held out, the first by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col(identifier).isNotNull() & ~held_out(identifier))
    order = F.xxhash64(F.col(identifier).cast("long"), F.lit(5))
    chosen = known.select(F.col(identifier).cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("y"), order.alias("o"))
    return chosen.orderBy("o", "doc_id", F.col("y").desc()).limit(sample).groupBy("doc_id").agg(F.max("y").alias("y"))


@dataclass
class Model:
    trees: Boosted
    learned: Lexicon
    abuse: np.ndarray
    second: np.ndarray

    def score(self, buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.trees.score(features(buffer, offsets, self.learned, self.abuse, self.second))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, texts, toxic texts) of the words and stems of each run of texts."""
    for batch in batches:
        y = batch.column(1).to_numpy()
        for first, last, buffer, offsets in slices(batch.column(0)):
            p = Profile(buffer, offsets)
            at, unit, _ = p.units()
            if not len(unit):
                continue
            text, unit = distinct(p.found.text[at], unit)
            units, group = np.unique(unit, return_inverse=True)
            bad = np.bincount(group, y[first:last][text], minlength=len(units)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(units.view(np.int64)), pa.array(np.bincount(group)), pa.array(bad)], names=["unit", "n", "bad"])


def _contexts(likely: np.ndarray):
    """The (unit, its head, part, hash of the word before, label) of each place where a unit of ``likely`` stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, part = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for first, last, buffer, offsets in slices(batch.column(0)):
                p = Profile(buffer, offsets)
                at, unit, head = p.units()
                hit = _member(unit, likely)
                at, unit, head = at[hit], unit[hit], head[hit]
                if len(at):
                    text = p.found.text[at]
                    follows = (at > 0) & (p.found.text[at - 1] == text)
                    before = np.where(follows, p.letters[at - 1], np.uint64(0))  # a text's first word has none
                    columns = [unit.view(np.int64), head.view(np.int64), part[first:last][text], before.view(np.int64), y[first:last][text].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["unit", "head", "part", "before", "bad"])

    return run


def _log_odds(bad, good, all_bad, all_good):
    """(log odds ratio, its standard errors) of counts in toxic and in other text."""
    odds = np.log((bad + 0.5) / (all_bad + 1.0)) - np.log((good + 0.5) / (all_good + 1.0))
    return odds, odds / np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))


def learn_lexicons(rows: DataFrame, n: int, bad: int, size: int = LEARNED) -> list[Lexicon]:
    """Words and stems that mark toxic text, from (text, y, part) rows: one lexicon learned without each part,
    and at last one learned on all.

    Candidates stand in enough toxic texts.  Each is then counted once for each word that it follows, so that
    copies of a text count once: what a few copied texts share is no mark of toxicity.
    """
    counts = rows.select("text", "y").mapInArrow(_frequencies, "unit long, n long, bad long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    good = F.col("n") - F.col("bad")
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((good + 0.5) / (n - bad + 1.0))
    z = odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (good + 0.5))
    frequent = counts.where(F.col("bad") >= max(MIN_TEXTS, bad // 100)).withColumn("z", z).where((odds > 0.7) & (F.col("z") > 1.0))
    likely = frequent.orderBy(F.col("z").desc(), "unit").limit(CANDIDATES).select("unit").collect()
    table = np.unique(np.array([r["unit"] for r in likely], np.int64).view(np.uint64))
    if not len(table):
        return [Lexicon.empty()] * (PARTS + 1)
    places = rows.select("text", "y", "part").mapInArrow(_contexts(table), "unit long, head long, part int, before long, bad long")
    once = places.groupBy("unit", "part", "before").agg(F.max("bad").alias("bad"), F.max("head").alias("head"))
    spread = once.groupBy("unit", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"), F.max("head").alias("head")).toArrow()
    words_in = np.zeros((2, PARTS))
    totals = rows.groupBy("y", "part").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("w")).collect()
    for r in totals:
        words_in[r["y"], r["part"]] = r["w"] or 0
    at = np.searchsorted(table, spread["unit"].to_numpy().view(np.uint64))
    seen = np.zeros((2, PARTS, len(table)))
    part, hits = spread["part"].to_numpy(), spread["bad"].to_numpy()
    np.add.at(seen, (1, part, at), hits)
    np.add.at(seen, (0, part, at), spread["n"].to_numpy() - hits)
    heads = np.zeros(len(table), np.uint64)
    heads[at] = spread["head"].to_numpy().view(np.uint64)
    out = []
    for without in [*range(PARTS), None]:
        use = [k for k in range(PARTS) if k != without]
        odds_of, z_of = _log_odds(seen[1, use].sum(axis=0), seen[0, use].sum(axis=0), words_in[1, use].sum(), words_in[0, use].sum())
        good_ones = np.flatnonzero((odds_of >= np.log(LIFT)) & (z_of >= MIN_Z))
        best = good_ones[np.lexsort((table[good_ones], -z_of[good_ones]))][:size]
        out.append(Lexicon.of(table[best], odds_of[best], heads[best]))
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE, learned_words: int = LEARNED) -> Model:
    """Fit on a bounded sample: the texts stay on the executors, only counts and features (some MB) reach the driver.

    Of rows that repeat an id one text counts, so the sample has at most ``sample`` texts however often ids repeat.
    """
    chosen = training_labels(labels, sample)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = known.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = one.select("doc_id", "y", "t.text")
    # copies mostly begin alike, and belong into one part
    part = F.pmod(F.xxhash64(F.substring("text", 1, 24)), F.lit(PARTS)).cast("int")
    rows = settle(rows.withColumn("part", part), "toxicity-sample")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad")).first()
    n, bad = totals["n"], totals["bad"] or 0
    abuse, second = fixed_lexicon(ABUSE), fixed_lexicon(SECOND_PERSON)
    lexicons = learn_lexicons(rows, n, bad, learned_words) if 0 < bad < n else [Lexicon.empty()] * (PARTS + 1)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(2).to_numpy()
            for first, last, buffer, offsets in slices(batch.column(3)):
                x = np.zeros((last - first, len(FEATURES)))
                for k in np.unique(parts[first:last]):
                    own = parts[first:last] == k
                    x[own] = features(buffer, offsets, lexicons[k], abuse, second)[own]
                columns = [batch.column(i).slice(first, last - first) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "part", "x"])

    measured = rows.select("doc_id", "y", "part", "text").mapInArrow(measure, "doc_id long, y int, part int, x array<double>").toArrow().sort_by("doc_id")
    y, part = measured["y"].to_numpy(), measured["part"].to_numpy()
    x = np.stack(measured["x"].to_numpy()) if len(y) else np.zeros((0, len(FEATURES)))
    # with few toxic texts all of them teach the trees, and the calibration too
    fold = part == 0 if bad >= CALIBRATE_APART else np.zeros(len(y), bool)
    least = max(1, min(8, bad // 8))
    return Model(boost(x, y, fold=fold, least=least), lexicons[-1], abuse, second)


def score_column(model: Model):
    """A pandas-free scorer for ``mapInArrow`` over (key, text) batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(buffer, offsets) for _, _, buffer, offsets in slices(batch.column(batch.num_columns - 1))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty(text).alias("text"))
    scored = small_batches(rows).mapInArrow(score_column(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, model: Model, text: str = "text", bar: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``bar`` or more, in one pass and without a shuffle."""
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(buffer, offsets) for _, _, buffer, offsets in slices(batch.column(at))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts) < bar))

    return small_batches(docs).mapInArrow(keep, docs.schema)
