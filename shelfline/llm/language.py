"""Language identification by segmentation-marginalised unigrams.

A public piece vocabulary is fixed. Each language has a probability for every piece;
the likelihood of a word is the sum, over all its segmentations into pieces, of the
products of their probabilities, which a forward pass over the word gives. Texts are
scored by the sum of the logarithms over their words.

Piece probabilities come from a few rounds of expectation maximisation on word counts
per language, gathered from a bounded sample of the learnable documents: of each
language ``TRAIN_DOCS`` expected documents, chosen by a hash of the id, and one at
least, so that a rare language is learned beside any number of documents of others. The
model has one number per language and piece. Scoring covers every whole text; each task
scores a distinct word once while it remembers it.

Letters are the characters of Unicode's letter categories; letter numbers and other
numeric characters are none. Memory for scores is bounded by words x languages.

Defined results: a null text or one without a letter is ``und`` with score 0; runs
longer than ``LONGEST`` letters are scored in consecutive parts; without learnable
documents every text is ``und``; ties go to the first language in code point order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.sources.storage import materialise

VOCABULARY = "piece_bpe_32k.model"
#: Expected documents to learn from, of each language.
TRAIN_DOCS = 8_000
ROUNDS = 2
START = "▁"
#: Marks a part of a long run that does not start it; no letter.
INSIDE = "+"
LONGEST = 40
#: Smoothing mass of a piece, probability of a character outside the vocabulary.
SMOOTH, UNKNOWN = 0.05, 1e-7
#: Numbers (distinct words x languages) a task remembers, and scores at once; characters
#: of texts whose new words are found together. More languages mean fewer words.
MEMO_CELLS, CELLS, RUN = 1_600_000, 200_000, 4_000_000
#: What \w matches beside letters, decimals and the underscore: numbers such as a half or a Roman four.
NUMBERS = "".join(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
NUMBER = re.compile(f"[{NUMBERS}]")
LETTERS = re.compile(r"[^\W\d_]+")
#: The same for Spark: a text with a letter.
LETTER = r"\p{L}"
#: Slots that ids are hashed to, of which a language's sample takes a share.
SLOTS = 1 << 30
UNDETERMINED = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case, long ones in parts; the parts after the first are
    no word starts and say so by a mark."""
    text = (text or "").lower()
    runs = LETTERS.findall(text)
    if runs and not "".join(runs).isalpha():  # a quick look; the pattern of numbers is slow
        runs = LETTERS.findall(NUMBER.sub(" ", text))
    if len(max(runs, key=len, default="")) < LONGEST:
        return runs
    parts = ((run[i : i + LONGEST - 1], i) for run in runs for i in range(0, len(run), LONGEST - 1))
    return [INSIDE + part if i else part for part, i in parts]


def marked(word: str) -> str:
    """The word as the vocabulary writes it: with a start mark unless it is a later part."""
    return word[1:] if word[0] == INSIDE else START + word


def vocabulary(path: str | None = None) -> dict[str, int]:
    """Pieces of the vocabulary that words of lower-case letters can hold."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (library.id_to_piece(i) for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i)))
    wanted = [p for p in pieces if p == START or LETTERS.fullmatch(p.removeprefix(START)) and p == p.lower()]
    return {p: i for i, p in enumerate(sorted(set(wanted)))}


class Pieces:
    """The vocabulary, found by the rolling hashes of substrings of many words at once."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, numbers: dict[str, int]):
        self.n, self.longest = len(numbers), max(map(len, numbers), default=1)
        self.keys = np.zeros(max(self.n, 1), np.uint64)
        for piece, number in numbers.items():
            value = np.zeros(1, np.uint64)
            for c in piece:
                value = self.roll(value, np.array([ord(c)], np.uint64))
            self.keys[number] = value[0]
        if len(np.unique(self.keys)) < self.n:
            raise ValueError("two pieces have the same hash")
        # Open addressing at a load of an eighth at most.
        self.bits = np.uint64(max(self.n * 8, 16).bit_length())
        self.table = np.full(1 << int(self.bits), -1, np.int32)
        for number in range(self.n):
            slot = int(self.slot(self.keys[number : number + 1])[0])
            while self.table[slot] >= 0:
                slot = (slot + 1) % len(self.table)
            self.table[slot] = number

    def roll(self, value: np.ndarray, char: np.ndarray) -> np.ndarray:
        mixed = (value + char + np.uint64(1)) * self.FACTOR
        return mixed ^ (mixed >> np.uint64(29))

    def slot(self, value: np.ndarray) -> np.ndarray:
        return (value * self.FACTOR >> (np.uint64(64) - self.bits)).astype(np.int64)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 for none."""
        slot = self.slot(value)
        found = self.table[slot]
        other = np.flatnonzero((found >= 0) & (self.keys[found] != value))
        while len(other):
            slot[other] = (slot[other] + 1) % len(self.table)
            found[other] = self.table[slot[other]]
            other = other[(found[other] >= 0) & (self.keys[found[other]] != value[other])]
        return found


class Lattice:
    """All segmentations of a list of words. Words of equal length are handled together:
    an arc set (from, to) has the words whose substring there is a piece."""

    def __init__(self, words: list[str], pieces: Pieces):
        self.n, self.unknown = len(words), pieces.n
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.groups = []
        for length in np.unique(lengths[lengths > 0]).tolist():
            members = np.flatnonzero(lengths == length)
            text = np.array([words[k] for k in members], dtype=f"<U{length}")
            chars = text.view(np.uint32).reshape(-1, length).astype(np.uint64)
            arcs = [[] for _ in range(length + 1)]
            for start in range(length):
                value = np.zeros(len(members), np.uint64)
                for end in range(start + 1, min(length, start + pieces.longest) + 1):
                    value = pieces.roll(value, chars[:, end - 1])
                    found = pieces.find(value)
                    if end == start + 1:
                        found[found < 0] = self.unknown
                    rows = np.flatnonzero(found >= 0)
                    if len(rows):
                        arcs[end].append((start, rows, found[rows]))
            self.groups.append((members, length, arcs))

    @staticmethod
    def _forward(members: np.ndarray, length: int, arcs: list, p: np.ndarray) -> np.ndarray:
        """alpha[position, word, language] for piece probabilities p[piece, language]."""
        alpha = np.zeros((length + 1, len(members), p.shape[1]))
        alpha[0] = 1
        for end in range(1, length + 1):
            for start, rows, piece in arcs[end]:
                alpha[end, rows] += alpha[start, rows] * p[piece]
        return alpha

    def log_likelihood(self, p: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, p.shape[1]))
        for members, length, arcs in self.groups:
            out[members] = np.log(np.maximum(self._forward(members, length, arcs, p)[length], 1e-300))
        return out

    def expected(self, p: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected uses of each piece when word w is seen count[w] times."""
        out = np.zeros_like(p)
        for members, length, arcs in self.groups:
            alpha = self._forward(members, length, arcs, p)
            beta = np.zeros_like(alpha)
            beta[length] = count[members][:, None] / np.maximum(alpha[length], 1e-300)
            for end in range(length, 0, -1):
                for start, rows, piece in arcs[end]:
                    onward = beta[end, rows] * p[piece]
                    beta[start, rows] += onward
                    np.add.at(out, piece, onward * alpha[start, rows])
        return out


def bounds(languages: int) -> tuple[int, int, int]:
    """Words a task remembers, words scored at once, and characters of a run."""
    return max(1_000, MEMO_CELLS // languages), max(250, CELLS // languages), max(50_000, RUN * 4 // max(4, languages))


def _runs(texts: pd.Series, most: int) -> Iterator[list[str | None]]:
    """Consecutive texts of about ``most`` characters."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def held_out(identity: str = "doc_id") -> Column:
    """Rows that nothing is learnt from; a row without an id is not learnt from either."""
    return F.coalesce(F.crc32(F.col(identity).cast("string")) % 5 == 0, F.lit(False))


def _probabilities(counts: dict[str, dict[int, float]], languages: list[str], pieces: int) -> np.ndarray:
    p = np.full((pieces + 1, len(languages)), SMOOTH)
    for k, language in enumerate(languages):
        for piece, n in counts.get(language, {}).items():
            p[piece, k] += n
    p[pieces] = 0
    p /= p.sum(axis=0)
    p[pieces] = UNKNOWN
    return p


def train(docs: DataFrame, vocabulary_path: str | None = None, train_docs: int = TRAIN_DOCS, identity: str = "doc_id", text: str = "text", language: str = "lang") -> tuple[list[str], dict[str, int], np.ndarray]:
    """Languages, pieces and piece probabilities (piece x language; last: unknown)."""
    pieces = vocabulary(vocabulary_path)
    usable = docs.select(F.col(identity).alias("id"), F.col(text).alias("t"), F.col(language).cast("string").alias("lang"))
    usable = usable.where(F.col("id").isNotNull() & F.col("t").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    usable = usable.where(F.col("t").rlike(LETTER)).withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(SLOTS)))
    # A row per language; the document with the smallest slot is always in the sample.
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min("slot").alias("least")).collect()
    below = [(r["lang"], max(int(min(1.0, train_docs / r["n"]) * SLOTS), r["least"] + 1)) for r in sizes]
    shares = F.broadcast(docs.sparkSession.createDataFrame(below, "lang string, below long"))
    sample = usable.join(shares, "lang").where("slot < below")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            spread = pd.DataFrame({"lang": frame["lang"], "word": frame["t"].map(words_of)}).explode("word").dropna()
            yield spread.groupby(["lang", "word"], sort=False).size().rename("n").reset_index()

    words = sample.select("lang", "t").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialise(words, "language_words")
    languages = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]
    p = _probabilities({}, languages, len(pieces))

    def uses(p: np.ndarray):
        def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = Pieces(pieces)
            for frame in frames:
                for name, part in frame.groupby("lang"):
                    k = languages.index(name)
                    for at in range(0, len(part), 20_000):
                        some = part.iloc[at : at + 20_000]
                        n = Lattice([marked(w) for w in some["word"]], found).expected(p[:, [k]], some["n"].to_numpy(float))[: len(pieces), 0]
                        seen = np.flatnonzero(n)
                        yield pd.DataFrame({"lang": name, "piece": seen, "uses": n[seen]})

        return task

    for _ in range(ROUNDS if languages else 0):
        gathered = words.mapInPandas(uses(p), "lang string, piece long, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
        counts: dict[str, dict[int, float]] = {}
        table = gathered.toArrow()  # one number per language and piece at most, in columns
        for name, piece, n in zip(*(table[c].to_pylist() for c in ("lang", "piece", "uses")), strict=True):
            counts.setdefault(name, {})[piece] = n
        p = _probabilities(counts, languages, len(pieces))
    return languages, pieces, p


def identify(docs: DataFrame, vocabulary_path: str | None = None, train_docs: int = TRAIN_DOCS, identity: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """One row per document row: id, ``held_out``, ``lang_pred`` and ``score``, the
    share of the best language among all at equal prior."""
    languages, pieces, p = train(docs, vocabulary_path, train_docs, identity, text, language)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found_by = Pieces(pieces)
        memo: dict[str, int] = {}
        most, at_once, characters = bounds(max(1, len(languages)))
        scores = np.zeros((0, len(languages)))
        for texts in batches:
            found = []
            for run in _runs(texts, characters):
                words = [words_of(t) if languages else [] for t in run]
                if len(memo) > most:
                    memo, scores = {}, scores[:0]
                new = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in memo]
                if len(memo) + len(new) > len(scores):
                    grown = np.zeros((max(len(memo) + len(new), 2 * len(memo)), len(languages)))
                    grown[: len(memo)] = scores[: len(memo)]
                    scores = grown
                for at in range(0, len(new), at_once):
                    some = new[at : at + at_once]
                    first = len(memo)
                    memo.update(zip(some, range(first, first + len(some)), strict=True))
                    scores[first : first + len(some)] = Lattice([marked(w) for w in some], found_by).log_likelihood(p)
                for own in words:
                    if not own:
                        found.append((UNDETERMINED, 0.0))
                        continue
                    total = np.zeros(len(languages))
                    for at in range(0, len(own), 10 * at_once):  # a long text has many words
                        some = own[at : at + 10 * at_once]
                        total += scores[np.fromiter(map(memo.__getitem__, some), np.int64, len(some))].sum(axis=0)
                    found.append((languages[int(total.argmax())], float(1 / np.exp(total - total.max()).sum())))
            yield pd.DataFrame(found, columns=["lang", "score"])

    rows = docs.select(F.col(identity), predict(F.col(text)).alias("__found"))
    return rows.select(
        identity, held_out(identity).alias("held_out"), F.col("__found.lang").alias("lang_pred"), F.col("__found.score").alias("score")
    )
