"""Subject areas of documents: term weighting, truncated SVD, and cosine to seed centroids refined iteratively.

A text is read as paragraphs (parted by empty lines) of sentences. A document has a subject if one of its paragraphs is
devoted to it, that is, if at least `SHARE` of the paragraph's sentences deal with it; a mention in a sentence or two of
a longer paragraph isn't enough. Sentences are embedded as weighted sums of term vectors of a truncated SVD and take the
subject of the nearest centroid; there is one centroid per subject and language, since a subject's terms in different
languages don't occur together.

1. Labelled documents are drawn, at most SAMPLE of them, and their terms are the vocabulary: the words and the pairs of
   neighbouring words in a sentence, frequent words left out of pairs; `control` and `beneficiary` may say little where
   `technical control` and `beneficiary clause` do. So the model's size is bounded by the sample, whatever the corpus.
2. Every document is laid out once as places of its terms in the vocabulary, written to the shared folder (`encode`);
   how often each term occurs in all documents is counted on the way.
3. The first model is fitted on the sample: terms weigh by inverse document frequency and by how unevenly they spread
   over the subjects (log-entropy), the SVD is that of the sample's paragraphs, and the seeds are the means of
   paragraphs by label; a paragraph of a document with several labels goes to the nearest.
4. ROUNDS times all documents are assigned with the model, and weights, SVD (a step of subspace iteration) and
   centroids are taken anew from sums over the whole corpus; the sums are bounded by vocabulary times rank.
5. All documents are assigned with the last model.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave import session

RANK, ROUNDS, SAMPLE, SHARE = 48, 2, 2_000, 0.4
#: A term is in the vocabulary if it occurs this often in the labelled documents drawn.
LEAST = 2
#: Unevenness of the spread over subjects from which a term counts, from 0 (even) to 1 (one subject only).
TOPICAL = 0.45
#: A sentence also speaks for a subject whose centroid is so near, in parts of the nearest one's cosine.
CLOSE = 0.75
SENTENCE_END, PARAGRAPH_END = -1, -2
#: Numbers or characters that are worked on at once; bounds memory, the result doesn't depend on it.
BLOCK = 1 << 20

#: Words have two letters at least.
_WORD = re.compile(r"[^\W\d_]{2,}")
#: Stands alone between blanks where a paragraph ends; a private character (alone in a text it ends a paragraph too).
_MARK = ""
_CLOSING = "\"'»”’)]"
# Frequent words that tell the languages apart.
STOPWORDS = {
    "fr": "le la les de des du et un une pour est que dans par sur qui au aux pas il vous ou",
    "en": "of the and to for is in not that be by with on if under your our this",
    "de": "der die das und den nicht mit fur ein eine sich von zu auf ist im wer bitte",
}
#: The last one is that of paragraphs without any such word.
LANGUAGES = (*STOPWORDS, "other")
_FOLD = {c: d for c in range(0xC0, 0x180) if (d := __import__("unicodedata").normalize("NFD", chr(c))[0]) != chr(c)} | {ord("œ"): "oe", ord("æ"): "ae", ord("ß"): "ss"}


def code(word: str) -> int:
    """The number of a word, without letter case and accents: 31 bits, from 0.

    Only numbers of the vocabulary count, so a word is taken for another one with a chance of vocabulary / 2^31.
    """
    return zlib.crc32(word.lower().translate(_FOLD).encode()) & 0x7FFFFFFF


class _Codes(dict):
    """Numbers of the words in a run of characters without blanks, as it is spelt; kept per worker, emptied when large."""

    def __missing__(self, run: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        value = tuple(map(code, _WORD.findall(run)))
        if run == _MARK:
            value = (PARAGRAPH_END,)
        elif run.rstrip(_CLOSING).endswith((".", "?", "!", "…")):
            value = (*value, SENTENCE_END)
        self[run] = value
        return value


@lru_cache(maxsize=1)
def _codes() -> _Codes:
    return _Codes()


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), then those of the next."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def encode_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, how many belong to each text): words, SENTENCE_END and PARAGRAPH_END, which also ends every text.

    Blanks part the runs of a text; a run that was met before is not read again.
    """
    if not len(texts):
        return np.empty(0, np.int32), np.empty(0, np.int64)
    marked = pc.binary_join_element_wise(pc.replace_substring_regex(texts.cast(pa.large_string()), pattern=r"\n[ \t\r]*\n", replacement=f" {_MARK} "), pa.scalar(f" {_MARK}", pa.large_string()), pa.scalar("", pa.large_string()))
    runs = pc.utf8_split_whitespace(marked)
    spelt = runs.flatten().dictionary_encode()
    get = _codes().__getitem__
    values = [get(run) for run in spelt.dictionary.to_pylist()]
    n = np.array([len(v) for v in values], np.int64)
    flat = np.array([x for v in values for x in v], np.int32)
    at = spelt.indices.to_numpy(zero_copy_only=False)
    long = n[at]
    ends = np.concatenate([[0], np.cumsum(long)])[np.cumsum(pc.list_value_length(runs).to_numpy(zero_copy_only=False))]
    return flat[_spread((np.cumsum(n) - n)[at], long)], np.diff(ends, prepend=0)


@lru_cache(maxsize=1)
def _frequent() -> np.ndarray:
    return np.sort(np.array([code(w) for words in STOPWORDS.values() for w in words.split()], np.int32))


def pair_numbers(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, number) of the pairs of neighbouring words, frequent words left out."""
    stop = _frequent()
    good = (flat >= 0) & (stop[np.minimum(np.searchsorted(stop, flat), len(stop) - 1)] != flat)
    at = np.flatnonzero(good[:-1] & good[1:])
    return at, ((flat[at].astype(np.int64) * 1_000_003 ^ flat[at + 1]) & 0x7FFFFFFF).astype(np.int32)


SLOTS = 1 << 21


class Vocabulary:
    """Sorted numbers of terms, and the place of each."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = numbers

    def __len__(self) -> int:
        return len(self.numbers)

    @cached_property
    def _slots(self) -> np.ndarray:
        """A place by the low bits of a number, -1 where no term has them."""
        table = np.full(SLOTS, -1, np.int32)
        table[self.numbers & (SLOTS - 1)] = np.arange(len(self))
        return table

    def places(self, numbers: np.ndarray) -> np.ndarray:
        """Places of terms by number, -1: not in the vocabulary."""
        if not len(self):
            return np.full(len(numbers), -1, np.int32)
        place = self._slots[numbers & (SLOTS - 1)]
        wrong = np.flatnonzero((self.numbers[place] != numbers) & (place >= 0))  # another term has the slot: look it up
        near = np.minimum(np.searchsorted(self.numbers, numbers[wrong]), len(self) - 1)
        place[wrong] = np.where(self.numbers[near] == numbers[wrong], near, -1)
        return place

    @cached_property
    def language(self) -> np.ndarray:
        """Of each term the language it is a frequent word of, -1: none."""
        out = np.full(len(self), -1)
        for i, words in enumerate(STOPWORDS.values()):
            out[np.isin(self.numbers, [code(w) for w in words.split()])] = i
        return out


def terms_of(flat: np.ndarray) -> np.ndarray:
    """Numbers of all terms of encoded texts."""
    return np.concatenate([flat[flat >= 0], pair_numbers(flat)[1]])


def lay_out(flat: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(cells, how many belong to each text) of encoded texts: the places of their terms, a pair behind its first word,
    and one SENTENCE_END behind every sentence with words, PARAGRAPH_END behind the last one of a paragraph."""
    word = np.flatnonzero(flat >= 0)
    if not len(word):
        return np.empty(0, np.int32), np.zeros(len(lengths), np.int64)
    sent, par = np.cumsum(flat < 0)[word], np.cumsum(flat == PARAGRAPH_END)[word]
    ends_sent, ends_par = np.append(sent[1:] != sent[:-1], True), np.append(par[1:] != par[:-1], True)
    single = vocabulary.places(flat[word])
    at, numbers = pair_numbers(flat)
    double = np.full(len(flat), -1, np.int32)
    double[at] = vocabulary.places(numbers)
    double = double[word]
    has, pair = single >= 0, double >= 0
    n = has.astype(np.int64) + pair + ends_sent
    first = np.cumsum(n) - n
    cells = np.empty(int(n.sum()), np.int32)
    cells[first[has]] = single[has]
    cells[(first + has)[pair]] = double[pair]
    cells[(first + has + pair)[ends_sent]] = np.where(ends_par, PARAGRAPH_END, SENTENCE_END)[ends_sent]
    doc = np.repeat(np.arange(len(lengths)), lengths)[word]
    return cells, np.bincount(doc, weights=n, minlength=len(lengths)).astype(np.int64)


def _blocks(sizes: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(first, behind the last) of runs of rows that together are about a block; a larger row is a run of its own."""
    at = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(at, (at[first - 1] if first else 0) + block, "right")))
        yield first, last
        first = last


def _binary(cells: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Numbers as one binary value per text."""
    offsets = np.concatenate([[0], np.cumsum(lengths * cells.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(cells))])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of `_binary`."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.int32)[offsets[0] // 4 : offsets[-1] // 4] if data else np.empty(0, np.int32), np.diff(offsets) // 4


CELLS = "doc_id bigint, cells binary, task bigint, slice int, part binary"


def encode(documents: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, cells BINARY) of all documents with a text (`lay_out`); whole texts, no exchange.

    Each task adds rows without doc_id for `add_up`: of each term how often it occurs, and last the number of paragraphs.
    """
    known = documents.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = known.value, np.zeros((len(known.value) + 1, 1))
        for batch in batches:
            texts = batch.column(1)
            for i, j in _blocks(pc.binary_length(texts).to_numpy(zero_copy_only=False), 4 * BLOCK):
                cells, lengths = lay_out(*encode_texts(texts.slice(i, j - i)), terms)
                total[:-1, 0] += np.bincount(cells[cells >= 0], minlength=len(terms))
                total[-1] += (cells == PARAGRAPH_END).sum()
                yield _cells(batch.column(0).slice(i, j - i), _binary(cells, lengths))
        yield from _parts(total)

    return documents.where(F.length(text) > 0).where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, CELLS)


def _cells(ids: pa.Array, cells: pa.Array) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([ids, cells, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["doc_id", "cells", "task", "slice", "part"])


# --- sums over all tasks ---------------------------------------------------------------------------------------------

#: Rows of a table of sums that travel together, and groups of tasks that are added up first.
SLICE, BUCKETS = 256, 1024


def _parts(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's sums (rows x columns) as rows for `add_up`."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for i in range(0, len(total), SLICE):
        part = total[i : i + SLICE]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([task], pa.int64()), pa.array([i // SLICE], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], ["doc_id", "cells", "task", "slice", "part"])


def add_up(parts: DataFrame, rows: int, columns: int) -> np.ndarray:
    """The sum (rows x columns) of what tasks counted: (task, slice, part).

    First the slices of a bucket of tasks are added up, then those of all buckets, so no group holds more than BUCKETS
    parts, or tasks / BUCKETS, of SLICE rows. The driver gets each row once.
    """

    def add(table: pa.Table) -> pa.Table:
        total = 0.0
        for part in table.column("part"):
            total = total + np.frombuffer(part.as_buffer(), np.float32).astype(np.float64)
        return pa.table({"slice": table.column("slice")[:1].cast(pa.int32()), "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    out = parts.where("slice IS NOT NULL").select("slice", "part", F.pmod("task", F.lit(BUCKETS)).cast("int").alias("bucket"))
    if parts.rdd.getNumPartitions() > BUCKETS:  # a bucket holds one task only otherwise
        out = out.groupBy("slice", "bucket").applyInArrow(add, "slice int, part binary")
    total = np.zeros((rows, columns))
    for r in out.select("slice", "part").groupBy("slice").applyInArrow(add, "slice int, part binary").toLocalIterator():
        part = np.frombuffer(bytes(r[1]), np.float32).reshape(-1, columns)
        total[r[0] * SLICE : r[0] * SLICE + len(part)] = part
    return total


# --- numbers of a block ----------------------------------------------------------------------------------------------


@dataclass
class Words:
    """The terms of some documents in order: place in the vocabulary and sentence of each; sentences with words are
    numbered through, `par_of` is a sentence's paragraph and `doc_of` a paragraph's document."""

    term: np.ndarray
    sent: np.ndarray
    par_of: np.ndarray
    doc_of: np.ndarray


def words_of(cells: np.ndarray, lengths: np.ndarray) -> Words:
    """Reads laid out documents."""
    mark = cells < 0
    at = np.flatnonzero(mark)
    ends = cells[at] == PARAGRAPH_END
    here = ~mark
    doc = np.repeat(np.arange(len(lengths)), lengths)
    return Words(cells[here], (np.cumsum(mark) - mark)[here], np.cumsum(ends) - ends, doc[at[ends]])


def _distinct(group: np.ndarray, term: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (group, term) in order."""
    pairs = np.sort(group.astype(np.int64) * max(1, terms) + term)
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
    return pairs // max(1, terms), pairs % max(1, terms)


#: Members of a group that are added member by member for all groups at once; longer groups are added group by group.
TOGETHER = 64


def _sums(table: np.ndarray, row: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums of rows of a table by group, which are in order: out[group[i]] += table[row[i]]."""
    out = np.zeros((groups, table.shape[1]), np.float32)
    if not len(row):
        return out
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    n = np.diff(first, append=len(group))
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    total = table[row[first]]
    for k in range(1, min(TOGETHER, int(n[0]))):
        some = int(np.searchsorted(-n, -k, "left"))  # groups of more than k
        total[:some] += table[row[first[:some] + k]]
    for i in range(int(np.searchsorted(-n, -TOGETHER, "left"))):
        total[i] += table[row[first[i] + TOGETHER : first[i] + n[i]]].sum(0)
    out[group[first]] = total
    return out


#: Terms whose sums are products of matrices, and paragraphs of one such product.
FREQUENT, PARAGRAPHS = 512, 4096


def _term_sums(z: np.ndarray, par: np.ndarray, term: np.ndarray, terms: int) -> np.ndarray:
    """Sums of paragraph vectors by term. The most frequent terms, which stand in most places, are counted per block of
    paragraphs (`par` is in order) and multiplied, which is faster than adding place by place."""
    often = np.argsort(-np.bincount(term, minlength=terms), kind="stable")[:FREQUENT]
    place = np.full(terms, -1, np.int32)
    place[often] = np.arange(len(often))
    row = place[term]
    dense = row >= 0
    rest = np.sort(term[~dense].astype(np.int64) * max(1, len(z)) + par[~dense])
    out = _sums(z, rest % max(1, len(z)), rest // max(1, len(z)), terms)
    par, row = par[dense], row[dense]
    ends = np.searchsorted(par, np.arange(0, len(z) + PARAGRAPHS, PARAGRAPHS))
    for low, i, j in zip(range(0, len(z), PARAGRAPHS), ends, ends[1:]):
        block = z[low : low + PARAGRAPHS]
        counts = np.bincount(row[i:j] * len(block) + par[i:j] - low, minlength=len(often) * len(block)).reshape(len(often), len(block))
        out[often] += counts.astype(np.float32) @ block
    return out


# --- the model -------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """vocabulary, idf, uneven (0 to 1), basis (terms x rank), centroids (subject-language x rank)."""

    vocabulary: Vocabulary
    idf: np.ndarray
    uneven: np.ndarray
    basis: np.ndarray
    centroids: np.ndarray
    subjects: int

    @cached_property
    def weight(self) -> np.ndarray:
        return weights(self.vocabulary, self.idf, self.uneven)

    @cached_property
    def place(self) -> np.ndarray:
        """Of each term its place among those with weight, -1: none."""
        out = np.full(len(self.vocabulary), -1, np.int32)
        on = np.flatnonzero(self.weight > 0)
        out[on] = np.arange(len(on))
        return out

    @cached_property
    def vectors(self) -> np.ndarray:
        """Weighted vectors of the terms with weight."""
        on = self.weight > 0
        return (self.weight[on, None] * self.basis[on]).astype(np.float32)

    @cached_property
    def products(self) -> np.ndarray:
        """Products of `vectors` with the centroids."""
        return (self.vectors @ self.centroids.T).astype(np.float32)


def weights(vocabulary: Vocabulary, idf: np.ndarray, uneven: np.ndarray) -> np.ndarray:
    """Frequent words have none."""
    return (idf * np.where((uneven >= TOPICAL) & (vocabulary.language < 0), uneven, 0) ** 2).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def unevenness(counts: np.ndarray) -> np.ndarray:
    """1 minus the normalised entropy of each term's spread over subjects (terms x subjects), corrected for their sizes.

    Terms seen in fewer than three places have 0. A little mass is added everywhere, so rare terms count for less; a
    subject of which little or nothing is known counts as a quarter of the average one.
    """
    seen, mean = counts.sum(1), max(counts.sum(), 1) / counts.shape[1]
    rate = (counts + 0.05) * mean / np.maximum(counts.sum(0), mean / 4)
    share = rate / rate.sum(1, keepdims=True)
    entropy = -(share * np.log(share)).sum(1) / np.log(max(2, counts.shape[1]))
    return np.where(seen >= 3, np.clip(1 - entropy, 0, 1), 0).astype(np.float32)


def languages_of(words: Words, vocabulary: Vocabulary) -> np.ndarray:
    """Language of each paragraph by its frequent words; the last one where it has none."""
    lang = vocabulary.language[words.term]
    telling = lang >= 0
    n = len(STOPWORDS)
    counts = np.bincount(words.par_of[words.sent[telling]] * n + lang[telling], minlength=len(words.doc_of) * n).reshape(-1, n)
    return np.where(counts.any(1), counts.argmax(1), n)


def assign(words: Words, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(subject of each paragraph or -1, sentence and place of each topical term, once a sentence).

    A sentence has the subject of the nearest centroid, and also speaks for those nearly as near (ambiguous terms); one
    without topical term has none. A paragraph has the subject that most of its sentences speak for, the one met first
    among equals, if these are at least SHARE of all its sentences.
    """
    n, pars, s = len(words.par_of), len(words.doc_of), model.subjects
    place = model.place[words.term]
    topical = place >= 0
    sent, term = _distinct(words.sent[topical], place[topical], len(model.vectors))
    # a sentence's products with the centroids are the sums of its terms'; its length doesn't change which is nearest
    at = np.flatnonzero(np.append(True, sent[1:] != sent[:-1])) if len(sent) else sent
    near = _sums(model.products, term, np.repeat(np.arange(len(at)), np.diff(at, append=len(sent))), len(at))
    for i in range(s, near.shape[1], s):  # the nearest of the languages' centroids
        np.maximum(near[:, :s], near[:, i : i + s], out=near[:, :s])
    near = np.ascontiguousarray(near[:, :s])
    best = near.argmax(1) if len(at) else at
    most = near[np.arange(len(at)), best]
    on = most > 1e-6
    near, best, most, on = near[on], best[on], most[on], sent[at][on]
    rows, cols = np.nonzero(near >= np.maximum(CLOSE * most, 1e-6)[:, None])
    support = np.bincount(words.par_of[on[rows]] * s + cols, minlength=pars * s).reshape(pars, s)
    first = np.full(pars * s, n, np.int64)
    own = words.par_of[on] * s + best
    first[own[::-1]] = on[::-1]  # the earliest sentence is written last
    rank = support - 0.5 * first.reshape(pars, s) / (n + 1)
    sentences = np.bincount(words.par_of, minlength=pars)
    top = rank.argmax(1) if pars else np.zeros(0, int)
    enough = support[np.arange(pars), top] >= np.maximum(SHARE * sentences, 1)
    return np.where(enough, top, -1), sent, term


@dataclass
class Sums:
    """What a round needs of the corpus: paragraphs by term and subject, term sums of paragraph vectors, centroid sums."""

    counts: np.ndarray
    terms: np.ndarray
    centroids: np.ndarray


def gather(words: Words, model: Model) -> Sums:
    """The sums of some documents under a model. Frequent words, which never have weight, are left out."""
    v, s = len(model.vocabulary), model.subjects
    par_subject, sent, place = assign(words, model)
    z = _unit(_sums(model.vectors, *reversed(_distinct(words.par_of[sent], place, len(model.vectors))), len(words.doc_of)))
    par = words.par_of[words.sent]
    of = par_subject[par]
    known = (of >= 0) & (model.vocabulary.language < 0)[words.term]
    par, of, term = par[known], of[known], words.term[known]
    counts = np.bincount(term.astype(np.int64) * s + of, minlength=v * s).reshape(v, s)
    sums = _term_sums(z, par, term, v)  # of every term: which will have weight, only the whole corpus tells
    cell = np.where(par_subject >= 0, languages_of(words, model.vocabulary) * s + par_subject, -1)
    set_ = np.flatnonzero(cell >= 0)
    set_ = set_[np.argsort(cell[set_], kind="stable")]
    return Sums(counts, sums, _sums(z, set_, cell[set_], len(LANGUAGES) * s))


def refit(model: Model, sums: Sums) -> Model:
    """The model of the next round. A centroid that nothing was assigned to stays."""
    uneven = unevenness(sums.counts)
    # the orthonormal axes nearest to the new images of the old ones, so that the centroids can be carried over
    u, _, vt = np.linalg.svd(weights(model.vocabulary, model.idf, uneven)[:, None] * sums.terms, full_matrices=False)
    moved = np.where(np.linalg.norm(sums.centroids, axis=1, keepdims=True) > 0, sums.centroids, model.centroids)
    return Model(model.vocabulary, model.idf, uneven, (u @ vt).astype(np.float32), _unit(moved).astype(np.float32), model.subjects)


def _leading(term: np.ndarray, group: np.ndarray, weight: np.ndarray, groups: int, rank: int, steps: int = 8) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of the weighted paragraphs of length one, by subspace iteration."""
    if not len(weight):
        return np.zeros((0, 0))
    length = np.sqrt(np.maximum(np.bincount(group, weights=weight[term] ** 2, minlength=groups), 1e-12))
    value = (weight[term] / length[group]).astype(np.float32)
    axes, _ = np.linalg.qr(np.random.default_rng(7).normal(size=(len(weight), min(rank, len(weight)))))
    for _ in range(steps):
        rows, images = np.empty(groups), np.empty_like(axes)
        for j in range(axes.shape[1]):
            rows = np.bincount(group, weights=value * axes[term, j], minlength=groups)
            images[:, j] = np.bincount(term, weights=value * rows[group], minlength=len(weight))
        axes, _ = np.linalg.qr(images)
    return axes


def first_model(words: Words, labels: list[list[int]], vocabulary: Vocabulary, idf: np.ndarray, subjects: int, rank: int = RANK) -> Model:
    """Fits weights, SVD and seeds on labelled documents, of which `labels` has the subjects."""
    v, pars = len(vocabulary), len(words.doc_of)
    allowed = np.zeros((len(labels), subjects), bool)
    for i, own in enumerate(labels):
        allowed[i, own] = True
    allowed = allowed[words.doc_of]
    group, term = _distinct(words.par_of[words.sent], words.term, v)
    lang = languages_of(words, vocabulary)
    guess = np.where(allowed.sum(1) == 1, allowed.argmax(1), -1)
    uneven = np.zeros(v, np.float32)
    for _ in range(3):
        known = guess[group] >= 0
        counts = np.bincount(term[known] * subjects + guess[group][known], minlength=v * subjects).reshape(v, subjects).astype(np.float64)
        uneven = unevenness(counts)
        # paragraphs of documents with several labels go to the label whose terms they hold
        lift = (counts / np.maximum(counts.sum(1, keepdims=True), 1) * (uneven**2)[:, None]).astype(np.float32)
        score = _sums(lift, term, group, pars) * allowed
        guess = np.where(score.max(1, initial=0) > 0.3, score.argmax(1), -1)
    model = Model(vocabulary, idf, uneven, np.zeros((v, rank), np.float32), np.zeros((0, rank), np.float32), subjects)
    topical = np.flatnonzero(model.weight > 0)
    heavy = model.weight[term] > 0
    term, group = model.place[term[heavy]], group[heavy]
    model.basis[topical, : min(rank, len(topical))] = _leading(term, group, model.weight[topical], pars, rank)
    z = _unit(_sums(model.vectors, term, group, pars))
    cell = np.where(guess >= 0, lang * subjects + guess, -1)
    known = np.flatnonzero(cell >= 0)
    known = known[np.argsort(cell[known], kind="stable")]
    model.centroids = _unit(_sums(z, known, cell[known], len(LANGUAGES) * subjects)).astype(np.float32)
    return model


# --- the pipeline ----------------------------------------------------------------------------------------------------


def _blocks_of(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, row behind the last, words) of blocks of laid out documents."""
    cells, lengths = _numbers(column)
    at = np.concatenate([[0], np.cumsum(lengths)])
    for i, j in _blocks(lengths):
        yield i, j, words_of(cells[at[i] : at[j]], lengths[i:j])


def gather_all(encoded: DataFrame, model: Model) -> Sums:
    """The sums over all documents: per task, then added up (`add_up`)."""
    v, k, s = len(model.vocabulary), model.basis.shape[1], model.subjects
    sent = encoded.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((v + len(LANGUAGES) * s, s + k))  # counts, then vectors
        for batch in batches:
            for _, _, words in _blocks_of(batch.column(0)):
                sums = gather(words, sent.value)
                total[:v, :s] += sums.counts
                total[:v, s:] += sums.terms
                total[v:, s:] += sums.centroids
        yield from _parts(total)

    parts = encoded.where("doc_id IS NOT NULL").select("cells").mapInArrow(run, CELLS)
    total = add_up(parts, v + len(LANGUAGES) * s, s + k)
    sent.unpersist()
    return Sums(total[:v, :s], total[:v, s:].astype(np.float32), total[v:, s:].astype(np.float32))


def draw(documents: DataFrame, labels: DataFrame, names: list[str], sample: int = SAMPLE) -> list[tuple[str, list[int]]]:
    """(text, subjects) of at most `sample` labelled documents, drawn by a hash of doc_id.

    Labels of unknown subjects are left out, repeated ones count once, and so do repeated documents.
    """
    index = {n.lower().strip(): i for i, n in enumerate(names)}
    clean = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.btrim("subject")).alias("s")).where("doc_id IS NOT NULL").where(F.col("s").isin(list(index)))
    ids = clean.groupBy("doc_id").agg(F.sort_array(F.collect_set("s")).alias("s")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.length("text") > 0)
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "s").agg(F.max("text").alias("text")).orderBy("doc_id").collect()
    return [(r["text"], [index[x] for x in r["s"]]) for r in found]


def vocabulary_of(texts: list[str], notes: list[str], least: int = LEAST) -> Vocabulary:
    """Terms that occur at least `least` times in the drawn texts, those of the notes, and the frequent words."""
    numbers, n = np.unique(terms_of(encode_texts(pa.array(texts, pa.string()))[0]), return_counts=True)
    return Vocabulary(np.unique(np.concatenate([numbers[n >= least], terms_of(encode_texts(pa.array(notes, pa.string()))[0]), _frequent()])).astype(np.int32))


def label(encoded: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """(doc_id, subject): every document with each of its subjects; documents without any have no row."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, words in _blocks_of(batch.column(1)):
                found, _, _ = assign(words, sent.value)
                on = found >= 0
                doc, subject = _distinct(words.doc_of[on], found[on], len(names))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + i)), pa.array(names, pa.string()).take(pa.array(subject))], ["doc_id", "subject"])

    return encoded.where("doc_id IS NOT NULL").select("doc_id", "cells").mapInArrow(run, "doc_id bigint, subject string").distinct()


def subject_areas(documents: DataFrame, subjects: DataFrame, labels: DataFrame, rank: int = RANK, rounds: int = ROUNDS, sample: int = SAMPLE, least: int = LEAST) -> DataFrame:
    """(doc_id, subject) of all documents. Null and empty texts, and an empty table of subjects, give no rows.

    subjects: (subject, titre, scope_note), labels: (doc_id, subject). The notes are seeds too, so a subject without
    labels still has one.
    """
    spark = documents.sparkSession
    known = subjects.where("subject IS NOT NULL").select("subject", F.concat_ws("\n\n", "titre", "scope_note").alias("note")).groupBy("subject").agg(F.max("note").alias("note")).orderBy("subject").collect()  # one row a subject
    if not known:
        return spark.createDataFrame([], "doc_id bigint, subject string")
    names, notes = [r[0] for r in known], [r[1] for r in known]
    drawn = draw(documents, labels, names, sample)
    vocabulary = vocabulary_of([t for t, _ in drawn], notes, least)
    path = session.scratch(spark, "cells")
    encode(documents, vocabulary).write.option("compression", "zstd").parquet(path)
    encoded = spark.read.parquet(path)
    counted = add_up(encoded, len(vocabulary) + 1, 1)[:, 0]
    idf = np.log(np.maximum(counted[-1], 1) / np.clip(counted[:-1], 1, max(counted[-1], 1))).astype(np.float32)
    seeds = words_of(*lay_out(*encode_texts(pa.array([t for t, _ in drawn] + notes, pa.string())), vocabulary))
    model = first_model(seeds, [x for _, x in drawn] + [[i] for i in range(len(names))], vocabulary, idf, len(names), rank)
    for _ in range(rounds):
        model = refit(model, gather_all(encoded, model))
    return label(encoded, model, names)
