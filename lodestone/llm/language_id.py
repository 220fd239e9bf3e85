"""Language identification by segmentation-marginalised unigrams.

The vocabulary is fixed and public: the pieces of a SentencePiece model, as plain
strings. A language is a unigram distribution over these pieces. A word's
probability in a language is the sum over all its segmentations into pieces of the
products of their probabilities, by a forward pass; a text's is the
product over its words. The posterior over the languages, from equal priors, gives
the prediction.

Training is expectation-maximisation: the forward-backward pass shares each word's
count among its pieces. It runs over the word counts of a bounded sample of
labelled rows (``SAMPLE_CHARS``).

Words are runs of non-white-space characters, lower-cased, each with the
word-start mark in front. A character that is no piece itself costs the same in each
language wherever a segmentation takes it alone. Words of any length are scored whole: words of up to ``SHORT`` characters
together, longer ones by a forward pass that rolls over the word with a window as long as the longest piece.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, fields, hold, id_crc, map_batches, table

#: Expected characters of the sample of each language, and EM rounds.
SAMPLE_CHARS, ROUNDS = 600_000, 3
#: Characters (the mark included) of words that are scored together, and of the longest words that train.
SHORT, TRAIN_LONGEST, MARK = 32, 200, "▁"
#: Words (of up to ``SHORT`` characters) that a worker remembers at most; beyond that it starts anew. Only speed depends on it.
CACHE_WORDS = 200_000
#: Words that are scored together; characters of texts that are split together; words of a text that are looked up at once.
WORDS_AT_ONCE, CHARS_AT_ONCE, RUN = 4096, 1 << 19, 50_000
UNKNOWN = 1e-6
FLOOR = 0.02  # added to each expected count
#: Factor for each character in training sums. It cancels out, and keeps long words from underflow.
STEP = 16.0
_memory: dict[str, Memory] = {}
_pieces: dict[str, dict[str, int]] = {}
_tries: dict[str, Trie] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> dict[str, int]:
    """The vocabulary's pieces, numbered; control and byte pieces are left out, and letters folded."""
    if path not in _pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        _pieces[path] = {p: i for i, p in enumerate(dict.fromkeys(names))}
    return _pieces[path]


def words_of(text: str) -> list[str]:
    return text.lower().split()


def runs_of_words(text: str) -> Iterator[list[str]]:
    """The words of a text, ``RUN`` at a time if it is a long one."""
    if len(text) <= CHARS_AT_ONCE:
        yield words_of(text)
        return
    run: list[str] = []
    for m in re.finditer(r"\S+", text.lower()):
        run.append(m[0])
        if len(run) == RUN:
            yield run
            run = []
    yield run


def lattice(part: str, vocab: dict[str, int], longest: int) -> list[tuple[int, int, int]]:
    """(start, end, piece); a character that is no piece itself gives piece -1."""
    n, out = len(part), []
    for i in range(n):
        single = False
        for j in range(i + 1, min(n, i + longest) + 1):
            p = vocab.get(part[i:j])
            if p is not None:
                out.append((i, j, p))
                single |= j == i + 1
        if not single:
            out.append((i, i + 1, -1))
    return out


@dataclass
class Model:
    languages: list[str]
    path: str
    longest: int
    prob: np.ndarray  # pieces and, last, the unknown character; by language
    name: str

    def score_words(self, words: list[str]) -> np.ndarray:
        """Each word's log probabilities; the forward passes of many words run together, end position by end position."""
        trie = Trie.of(self.path)
        out = np.zeros((len(words), len(self.languages)))
        short = [w for w, word in enumerate(words) if len(word) < SHORT]
        for w in set(range(len(words))).difference(short):
            out[w] = self.score_long(MARK + words[w])
        for begin in range(0, len(short), WORDS_AT_ONCE):
            owner = np.array(short[begin : begin + WORDS_AT_ONCE])
            parts = [MARK + words[w] for w in owner.tolist()]
            length = np.array([len(part) for part in parts])
            part, i, j, p = trie.edges(parts)
            order = np.argsort(j.astype("i8") << 32 | part, kind="stable")
            part, i, j, p = part[order], i[order], j[order], p[order]
            bounds = np.searchsorted(j, np.arange(1, SHORT + 2))
            alpha = np.zeros((SHORT + 1, len(owner), len(self.languages)))
            alpha[0] = 1
            for end in range(1, SHORT + 1):
                at = slice(bounds[end - 1], bounds[end])
                if at.start < at.stop:
                    first = np.flatnonzero(np.diff(part[at], prepend=-1))
                    alpha[end, part[at][first]] = np.add.reduceat(alpha[i[at], part[at]] * self.prob[p[at]], first)
            out[owner] = np.log(np.maximum(alpha[length, np.arange(len(owner))], 1e-300))
        return out

    def score_long(self, word: str) -> np.ndarray:
        """The log probabilities of a word (with its mark) of any length: only sums of the last ``longest`` positions are kept, scaled anew as they shrink."""
        vocab, begins = pieces(self.path), Trie.of(self.path).begins
        size = self.longest + 1
        alpha, logs = np.zeros((size, len(self.languages))), np.zeros(len(self.languages))
        alpha[0] = 1
        coming: list[list[tuple[int, int]]] = [[] for _ in range(size)]  # by end position: (start, piece)
        for i in range(len(word)):
            single = False
            for j in range(i + 1, min(len(word), i + self.longest) + 1):
                prefix = word[i:j]
                if (p := vocab.get(prefix)) is not None:
                    coming[j % size].append((i % size, p))
                    single |= j == i + 1
                if prefix not in begins:
                    break
            if not single:
                coming[(i + 1) % size].append((i % size, -1))
            end = (i + 1) % size
            starts, by = zip(*coming[end])
            alpha[end] = (alpha[list(starts)] * self.prob[list(by)]).sum(axis=0)
            coming[end] = []
            if i % 16 == 15:
                scale = np.maximum(alpha[end], 1e-300)
                alpha /= scale
                logs += np.log(scale)
        return logs + np.log(np.maximum(alpha[len(word) % size], 1e-300))

    def posteriors(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The posterior of each text over the languages; None for a text without a letter."""
        hold(_memory, _pieces, _tries)
        known = _memory.setdefault(self.name, Memory(len(self.languages)))
        total, some, size = np.zeros((len(texts), len(self.languages))), [], 0

        def add() -> None:
            words = {w for _, ws in some for w in ws}
            long = {w: self.score_long(MARK + w) for w in words if len(w) >= SHORT}
            known.learn(words.difference(long), self)
            row = known.row
            for k, ws in some:
                if long:
                    total[k] += sum(long[w] for w in ws if w in long)
                    ws = [w for w in ws if w not in long]
                total[k] += known.logs[[row[w] for w in ws]].sum(axis=0)
            some.clear()

        read = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        for k, t in enumerate(texts):
            for ws in runs_of_words(t) if read[k] else ():
                some.append((k, ws))
                size += sum(map(len, ws))
                if size >= CHARS_AT_ONCE:
                    add()
                    size = 0
        add()
        e = np.exp(total - total.max(axis=1, keepdims=True))
        e /= e.sum(axis=1, keepdims=True)
        return [p if ok else None for p, ok in zip(e, read)]

    def posterior(self, text: str | None) -> np.ndarray | None:
        return self.posteriors([text])[0]


class Trie:
    """The pieces as a table of transitions over their most frequent characters, walked for many words at once."""

    def __init__(self, path: str, letters: int = 120):
        vocab = pieces(path)
        self.vocab, self.longest = vocab, max(map(len, vocab))
        self.begins = frozenset(p[:n] for p in vocab for n in range(1, len(p)))
        often = [c for c, _ in sorted(Counter(c for p in vocab for c in p).items(), key=lambda x: (-x[1], x[0]))]
        self.kind = np.zeros(0x110000, "i2")  # 0: in no piece; -1: not in the table
        for c in often[letters:]:
            self.kind[ord(c)] = -1
        for k, c in enumerate(often[:letters], 1):
            self.kind[ord(c)] = k
        nodes: dict[str, int] = {"": 0}
        for p in vocab:
            if all(self.kind[ord(c)] > 0 for c in p):
                for n in range(1, len(p) + 1):
                    nodes.setdefault(p[:n], len(nodes))
        dead = len(nodes)
        self.next = np.full((dead + 1, letters + 1), dead, "i4")
        self.piece = np.full(dead + 1, -1, "i4")
        for p, k in nodes.items():
            if p:
                self.next[nodes[p[:-1]], self.kind[ord(p[-1])]] = k
            self.piece[k] = vocab.get(p, -1)
        self.dead = dead

    @classmethod
    def of(cls, path: str) -> Trie:
        if path not in _tries:
            _tries[path] = cls(path)
        return _tries[path]

    def edges(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(part, start, end, piece) of all lattices. Parts with a character outside the table go the plain way."""
        text = "".join([p.ljust(SHORT, "\0") for p in parts]).encode("utf-32-le", "surrogatepass")
        kind = self.kind[np.frombuffer(text, "<u4").reshape(len(parts), SHORT)]
        length = np.array([len(p) for p in parts])
        plain = (kind < 0).any(axis=1)
        out = [[], [], [], []]
        for start in range(int(length.max())):
            at = np.flatnonzero(~plain & (length > start))
            state = np.zeros(len(at), "i4")
            for end in range(start + 1, SHORT + 1):
                state = self.next[state, kind[at, end - 1]]
                piece = self.piece[state]
                take = piece >= 0 if end > start + 1 else np.ones(len(at), bool)  # one character always is a step
                for column, x in zip(out, (at[take], start, end, piece[take])):
                    column.append(x if isinstance(x, np.ndarray) else np.full(int(take.sum()), x))
                alive = (state != self.dead) & (length[at] > end)
                at, state = at[alive], state[alive]
                if not len(at):
                    break
        rest = [(k, *e) for k in np.flatnonzero(plain).tolist() for e in lattice(parts[k], self.vocab, self.longest)]
        if rest:
            for column, x in zip(out, np.array(rest).T):
                column.append(x)
        return tuple(np.concatenate(c).astype("i8") for c in out)


class Memory:
    """Words of fewer than ``SHORT`` characters that a worker has met, with their log probabilities."""

    def __init__(self, n_languages: int):
        self.row: dict[str, int] = {}
        self.logs = np.empty((0, n_languages))

    def learn(self, words: set[str], model: Model) -> None:
        if len(self.row) + len(words) > CACHE_WORDS:
            self.row, self.logs = {}, self.logs[:0].copy()
        new = [w for w in words if w not in self.row]
        if new:
            n = len(self.row)
            self.row.update(zip(new, range(n, n + len(new))))
            if n + len(new) > len(self.logs):
                self.logs = np.concatenate([self.logs[:n], np.empty((max(len(new), n // 2), self.logs.shape[1]))])
            self.logs[n : n + len(new)] = model.score_words(new)


def train(words: dict[str, Counter], path: str, rounds: int = ROUNDS) -> Model:
    """EM over each language's word counts. A word's expected piece counts come from its forward and backward sums.

    Words of over ``TRAIN_LONGEST`` characters, or so unlikely that their probability underflows, don't train.
    """
    vocab = pieces(path)
    longest = max(map(len, vocab))
    languages = sorted(words)
    prob = np.empty((len(vocab) + 1, len(languages)))
    step = STEP ** np.array([*map(len, vocab), 1])
    for k, language in enumerate(languages):
        lattices = [(lattice(MARK + w, vocab, longest), len(w) + 1, c) for w, c in words[language].items() if len(w) < TRAIN_LONGEST]
        p = np.full(len(vocab) + 1, 1.0 / len(vocab))
        p[-1] = UNKNOWN
        for _ in range(rounds):
            expected = np.full(len(vocab) + 1, FLOOR)
            q = (p * step).tolist()
            for edges, n, c in lattices:
                alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
                alpha[0] = beta[n] = 1.0
                for i, j, x in edges:
                    alpha[j] += alpha[i] * q[x]
                if alpha[n] <= 0:
                    continue
                for i, j, x in reversed(edges):
                    beta[i] += beta[j] * q[x]
                scale = c / alpha[n]
                for i, j, x in edges:
                    expected[x] += alpha[i] * q[x] * beta[j] * scale
            p = expected / expected[:-1].sum()
            p[-1] = UNKNOWN
        prob[:, k] = p
    return Model(languages, path, longest, prob, hashlib.sha256(prob.tobytes() + repr(languages).encode()).hexdigest())


def fit(labelled: DataFrame, path: str | None = None, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fits on a bounded sample of (doc_id, text, lang): rows are chosen by a hash of doc_id so that each language has about ``sample_chars`` characters, in whole texts.

    Rows with null text or lang are passed over. Without any rows the model has no languages and predicts ``und``.
    """
    spark = labelled.sparkSession
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text").cast("long")).alias("n")).collect()}
    path = path or default_vocabulary()
    if not sizes:
        return Model([], path, 1, np.ones((len(pieces(path)) + 1, 0)), "none")
    shares = spark.createDataFrame([(k, min(1.0, sample_chars / max(1, n))) for k, n in sizes.items()], "__lang string, __share double")
    at = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.join(F.broadcast(shares), F.col("lang") == F.col("__lang")).where(at < F.col("__share"))
    words: dict[str, Counter] = {k: Counter() for k in sizes}
    for r in chosen.select("lang", "text").toLocalIterator():
        words[r["lang"]].update(words_of(r["text"]))
    return train({k: c for k, c in words.items() if c}, path)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``text``'s lang_pred and score for each row; other columns of ``docs`` stay, but for text.

    lang_pred is ``und`` and the score 0 if text is null or has no letter, or if the model has no
    languages. Ties go to the language that sorts first. Ids may be null or repeat; an empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*columns(docs, "text", "lang_pred", "score"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for b in batches:
            langs, scores = [], []
            texts = b.column(b.num_columns - 1).to_pylist()
            for p in model.posteriors(texts) if model.languages else [None] * len(texts):
                k = 0 if p is None else int(p.argmax())
                langs.append("und" if p is None else model.languages[k])
                scores.append(0.0 if p is None else float(p[k]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    return map_batches(rows, run, fields(rows, "lang_pred string, score double", ("text",)))


def keep_languages(docs: DataFrame, model: Model, languages: list[str] | None = None, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with its columns, whose text has one of ``languages`` (all learned ones) with at least ``least_score``."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    wanted = set(languages or model.languages)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            ps = model.posteriors(texts) if model.languages else [None] * len(texts)
            stays = [p is not None and p.max() >= least_score and model.languages[int(p.argmax())] in wanted for p in ps]
            yield b.filter(pa.array(stays, pa.bool_()))

    return map_batches(docs, run, schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document. Null ids are never held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_crc() % 3 == 1, F.lit(False))
    model = fit(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
