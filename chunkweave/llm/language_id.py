"""Language identification by unigram piece models that sum over all segmentations.

A fixed public vocabulary gives the pieces. For each language, probabilities of its pieces are learned
by expectation maximisation. The probability of a word is the sum over all ways to cut it into pieces
(forward algorithm); a text's is the product over its words. No decision on a segmentation is ever made.

The score compares the learned languages with one another and says nothing about texts in none of them.
``with_language`` therefore asks for a least level as well: the logarithm of the text's probability under
its best language per letter, against what that language's training rows reach.

Words are runs of letters, lower-cased, with a mark for the word start; runs of more than 32 letters are
scored in parts of 32. Word probabilities are computed once per distinct word and batch for all
languages together, in numpy; texts of any length are taken in slices.

The words of the training rows are counted in Spark, and each round's expected counts are summed in Spark;
only pieces x languages numbers reach the driver. ``with_language`` learns from all training rows, and its
least levels are quantiles over all of them. ``identify`` learns from a bounded sample: of each language's
training rows, those whose hash falls below a share that makes ``docs_per_language`` rows expected.

Defined results: ``und`` with score 0 for a null or empty text or one without a letter, and for every
text if no language could be learned; equal scores go to the alphabetically first language; rows with a
null ``doc_id`` or language are predicted but not learned from. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkweave.llm.common import stored

START = "▁"  # the vocabulary's mark of a word start
PART = 32
SLICE = 1 << 20
BATCH_CHARS = 1 << 20
CACHED_WORDS = 200_000
UNKNOWN = 1e-9
SMOOTHING = 0.05
ROUNDS = 4
DOCS_PER_LANGUAGE = 1000
#: The least level of a language: this quantile of its training rows, less a margin, less a slack over the
#: number of letters (short texts vary more).
LEVEL_QUANTILE = 0.01
LEVEL_MARGIN = 1.0
LEVEL_SLACK = 10.0
LEVEL_DIGITS = 3

_LETTERS = regex.compile(r"\p{L}{1,%d}" % PART)
_NO_LETTER = regex.compile(r"\P{L}")


def vocabulary_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model that can occur in lower-cased words."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return sorted({p for p in found if p == p.lower() and _LETTERS.fullmatch(p.removeprefix(START) or "a")})


class PieceTable:
    """Finds the pieces at every place of many words of one length, by hashes of the substrings."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    BITS = 21

    def __init__(self, pieces: list[str]):
        self.longest = max((len(p) for p in pieces), default=1)
        keys = np.array([self._key(p) for p in pieces], dtype=np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.present = np.zeros(1 << self.BITS, dtype=bool)
        self.present[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    @staticmethod
    def _spread(codes: np.ndarray) -> np.ndarray:
        x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    def _key(self, piece: str) -> int:
        codes = self._spread(np.array([ord(c) for c in piece], dtype=np.uint64))
        h = np.zeros(1, dtype=np.uint64)
        for code in codes:
            h = (h + code) * self.BASE
        return int(h[0])

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        ids = np.full(len(hashes), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.present[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)])
        if len(maybe) and len(self.keys):
            wanted = hashes[maybe]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[at] == wanted
            ids[maybe[hit]] = self.order[at[hit]]
        return ids

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """``(start, end, piece id or -1 per word)`` for words of one length, by start, then end."""
        length = len(words[0])
        codes = self._spread(np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), length))
        for start in range(length):
            h = np.zeros(len(words), dtype=np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                h = (h + codes[:, end - 1]) * self.BASE
                yield start, end, self.lookup(h)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        found.setdefault(len(word), []).append(i)
    return found


def word_scores(words: list[str], pieces: PieceTable, probability: np.ndarray) -> np.ndarray:
    """Logarithm of each word's probability (rows) in each language (columns)."""
    scores = np.zeros((len(words), probability.shape[1]))
    for length, at in _by_length(words).items():
        group = [START + words[i] for i in at]
        total = np.zeros((length + 2, len(group), probability.shape[1]))
        total[0] = 1
        for start, end, ids in pieces.matches(group):
            known = ids >= 0
            total[end][known] += total[start][known] * probability[ids[known]]
            if end == start + 1:
                total[end][~known] += total[start][~known] * UNKNOWN
        scores[at] = np.log(np.maximum(total[length + 1], 1e-300))
    return scores


def expected_counts(words: list[str], language: np.ndarray, number: np.ndarray, pieces: PieceTable, probability: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece (rows) in each language (columns), by forward and backward sums."""
    n_languages = probability.shape[1]
    counts = np.zeros(probability.size)
    for length, at in _by_length(words).items():
        at = np.array(at)
        group, own, times = [START + words[i] for i in at], language[at], number[at]
        steps = list(pieces.matches(group))
        forward, backward = np.zeros((length + 2, len(group))), np.zeros((length + 2, len(group)))
        forward[0] = 1
        backward[length + 1] = 1

        def weight(start, end, ids):
            return np.where(ids >= 0, probability[ids, own], UNKNOWN if end == start + 1 else 0.0)  # noqa: B023

        for start, end, ids in steps:
            forward[end] += forward[start] * weight(start, end, ids)
        for start, end, ids in reversed(steps):
            backward[start] += backward[end] * weight(start, end, ids)
        whole = np.maximum(forward[length + 1], 1e-300)
        places, uses = [], []
        for start, end, ids in steps:
            known = ids >= 0
            use = times * forward[start] * weight(start, end, ids) * backward[end] / whole
            places.append(ids[known] * n_languages + own[known])
            uses.append(use[known])
        counts += np.bincount(np.concatenate(places), np.concatenate(uses), len(counts))
    return counts.reshape(probability.shape)


def slices(text: str) -> Iterator[str]:
    """The text in slices of about a million characters, cut at a character that is no letter."""
    start = 0
    while start < len(text):
        end = start + SLICE
        if end < len(text):
            cut = _NO_LETTER.search(text, end)
            end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


class Scorer:
    """Sums the word scores of texts; keeps the scores of words it has met, up to a bound."""

    def __init__(self, pieces: list[str], probability: np.ndarray):
        self.pieces, self.probability = PieceTable(pieces), probability
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, self.probability.shape[1]))

    def _learn(self, words: list[str]) -> None:
        first = len(self.number)
        self.number.update(zip(words, range(first, first + len(words)), strict=True))
        while len(self.scores) < len(self.number):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            self.scores[first + at : first + at + len(part)] = word_scores(part, self.pieces, self.probability)

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score per text and language, and number of letters per text."""
        totals, n_letters = np.zeros((len(texts), self.probability.shape[1])), np.zeros(len(texts), dtype=np.int64)
        waiting: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            if len(self.number) > CACHED_WORDS:
                self._forget()
            new = dict.fromkeys(w for _, words in waiting for w in words)
            self._learn([w for w in new if w not in self.number])
            for i, words in waiting:
                totals[i] += self.scores[np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))].sum(axis=0)
                n_letters[i] += sum(map(len, words))

        for i, text in enumerate(texts):
            for part in slices(text):
                waiting.append((i, _LETTERS.findall(part.lower())))
                size += len(part)
                if size >= BATCH_CHARS:
                    settle()
                    waiting, size = [], 0
        settle()
        return totals, n_letters


def with_language(docs: DataFrame, vocabulary: str, min_score: float, docs_per_language: int | None = None) -> DataFrame:
    """The rows whose language is recognised with at least this score and is likely enough in itself; all
    columns stay as they are. All training rows are learned from, unless ``docs_per_language`` asks for a
    sample. Texts are judged once, and the rows stored with what was found: the least levels come from all
    of them."""
    learned = learn_from(docs, vocabulary, docs_per_language)
    state = docs.sparkSession.sparkContext.broadcast(learned)

    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = TextJudge(*state.value)
        for column in texts:
            yield pa.StructArray.from_arrays(scorer.judge(column), names=["language", "score", "level", "letters"])

    name = "_judged"
    while name in docs.columns:
        name += "_"
    judged = F.arrow_udf(judge, "language string, score double, level double, letters long").asNondeterministic()
    found = stored(docs.withColumn(name, judged("text")), "language-judged")
    least = least_levels(found, name)
    language, score, level, letters = (F.col(f"{name}.{part}") for part in ("language", "score", "level", "letters"))
    recognised = (language != "und") & (score >= min_score)
    if least:
        bound = F.create_map(*[F.lit(x) for item in least.items() for x in item])[language] - LEVEL_SLACK / letters
        recognised &= F.coalesce(level >= bound, F.lit(True))
    return found.filter(recognised).drop(name)


class TextJudge:
    """Predicts the languages of texts in a task."""

    def __init__(self, pieces: list[str], languages: list[str], probability: np.ndarray):
        self.languages = languages
        self.scorer = Scorer(pieces, probability) if languages else None

    def judge(self, column: pa.Array) -> list[pa.Array]:
        """Language, score, level and number of letters of each text, in groups of bounded size."""
        rows = len(column)
        best, score, level, letters = np.zeros(rows, dtype=np.int64), np.zeros(rows), np.zeros(rows), np.zeros(rows, dtype=np.int64)
        at = 0
        while at < rows and self.scorer is not None:
            size, end, texts = 0, at, []
            while end < rows and size < BATCH_CHARS:
                texts.append(column[end].as_py() or "")
                size += len(texts[-1])
                end += 1
            totals, letters[at:end] = self.scorer.totals(texts)
            level[at:end] = totals.max(axis=1) / np.maximum(letters[at:end], 1)
            share = np.exp(totals - totals.max(axis=1, keepdims=True))
            best[at:end] = share.argmax(axis=1)
            score[at:end] = share.max(axis=1) / share.sum(axis=1)
            at = end
        known = letters > 0
        predicted = [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
        return [pa.array(predicted, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(level), pa.array(letters)]


def least_levels(judged: DataFrame, name: str) -> dict[str, float]:
    """The least level of each language by all training rows that are recognised as theirs, from rows with
    what was found in the column ``name``. Levels are counted to ``LEVEL_DIGITS`` digits, so the counts are
    few, whatever the number of rows."""
    language, level, letters = (F.col(f"{name}.{part}") for part in ("language", "level", "letters"))
    own = judged.filter(_is_training() & (letters > 0) & (language == F.col("lang")))
    counts = own.groupBy("lang", F.round(level, LEVEL_DIGITS).alias("level")).agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy("lang").orderBy("level"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    low = counts.select("lang", "level", below.alias("below"), total.alias("total")).filter(F.col("below") >= LEVEL_QUANTILE * F.col("total"))
    return {row["lang"]: row["low"] - LEVEL_MARGIN for row in low.groupBy("lang").agg(F.min("level").alias("low")).collect()}  # a row per language


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, lang)`` of the rows that are learned from."""
    return docs.filter(_is_training()).select("doc_id", "text", "lang")


def _is_training() -> Column:
    return F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()


def sampled(training: DataFrame, docs_per_language: int | None) -> DataFrame:
    """About so many rows of each language, chosen by hash; all rows without a number."""
    if docs_per_language is None:
        return training
    sizes = training.groupBy("lang").count().collect()  # a row per language, as the model has a column
    if not sizes:
        return training
    number = F.create_map(*[F.lit(x) for row in sizes for x in (row["lang"], row["count"])])
    share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return training.filter(share * number[F.col("lang")] < docs_per_language)


def training_words(training: DataFrame, docs_per_language: int | None) -> DataFrame:
    """``(language, word, n)`` of the sampled rows of ``training(doc_id, text, lang)``."""
    chosen = sampled(training, docs_per_language)

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in slices(text.as_py()):
                    found.update((language, word) for word in _LETTERS.findall(part.lower()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in found], pa.string()),
                    pa.array([k[1] for k in found], pa.string()),
                    pa.array(list(found.values()), pa.int64()),
                ],
                names=["language", "word", "n"],
            )

    counted = chosen.select("lang", "text").mapInArrow(count, "language string, word string, n long")
    return counted.groupBy("language", "word").agg(F.sum("n").alias("n"))


def learn(training: DataFrame, pieces: list[str], docs_per_language: int | None = DOCS_PER_LANGUAGE, rounds: int = ROUNDS):
    """``(languages, probabilities of pieces x languages)``; the languages are sorted."""
    spark = training.sparkSession
    words = stored(training_words(training, docs_per_language), "language-words")
    languages = sorted(r.language for r in words.select("language").distinct().collect())
    shape = (len(pieces), len(languages))
    probability = np.full(shape, 1.0 / max(1, len(pieces)))
    for _ in range(rounds if languages else 0):
        state = spark.sparkContext.broadcast((pieces, languages, probability))

        def expect(batches, state=state):
            own_pieces, own_languages, own = state.value
            found, number = PieceTable(own_pieces), {name: i for i, name in enumerate(own_languages)}
            counts = np.zeros(own.shape)
            for batch in batches:
                language = np.array([number[name] for name in batch.column(0).to_pylist()], dtype=np.int64)
                texts, times = batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
                counts += expected_counts(texts, language, times, found, own)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts.ravel()[at])], names=["at", "uses"])

        sums = words.mapInArrow(expect, "at long, uses double").groupBy("at").agg(F.sum("uses").alias("uses")).toArrow()
        counts = np.full(probability.size, SMOOTHING)
        counts[sums.column("at").to_numpy()] += sums.column("uses").to_numpy()
        probability = counts.reshape(shape) / counts.reshape(shape).sum(axis=0)
    return languages, probability


def predict(
    docs: DataFrame, pieces: list[str], languages: list[str], probability: np.ndarray, keep=("doc_id",), names=("lang_pred", "score")
) -> DataFrame:
    """The kept columns, the predicted language and its score (``names``): its share of the summed
    probabilities of all languages. Two more names ask for the level (logarithm of the text's probability in
    that language per letter) and the number of letters."""
    wanted = docs.select(F.col("text").alias("_text"), *keep)
    state = docs.sparkSession.sparkContext.broadcast((pieces, languages, probability))

    def run(batches):
        judge = TextJudge(*state.value)
        for batch in batches:
            found = judge.judge(batch.column(0))[: len(names)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *found], names=[*keep, *names])

    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.LongType())
    schema = T.StructType([*wanted.schema.fields[1:], *[T.StructField(name, kind) for name, kind in zip(names, kinds, strict=False)]])
    return wanted.mapInArrow(run, schema)


def learn_from(docs: DataFrame, vocabulary: str, docs_per_language: int | None = DOCS_PER_LANGUAGE) -> tuple:
    """Pieces, languages and probabilities, learned from the rows that are not held out."""
    pieces = vocabulary_pieces(vocabulary)
    return pieces, *learn(training_rows(docs), pieces, docs_per_language)


def identify(docs: DataFrame, vocabulary: str, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``; rows with ``held_out`` are never learned from."""
    predicted = predict(docs, *learn_from(docs, vocabulary, docs_per_language))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
