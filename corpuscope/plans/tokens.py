"""Rows that a document's own tokens give, made in one pass where the document lies: no token is shuffled or sorted.

tok(doc_id, pos, field, surface, stem, term), one row a token; doc_terms, one row a document and stem; doc_words, one a
document and word; dw_lists, a document's words that vectors are trained on and their counts, vsm_lists, those of title and abstract;
doc_sizes and top_terms; and by task, not by document, the counts of words (PARTS).
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.porter import stem
from corpuscope.functions.stopwords import STOP_WORDS

#: Documents and bytes of text that are worked on at a time, stems that a worker keeps, words whose counts a task holds.
ROWS, BYTES, KEPT, HELD = 256, 8 << 20, 300_000, 500_000
SCHEMAS = {
    "tok": "pos bigint, field string, surface string, stem string, term string",
    "doc_terms": "term string, n_all bigint, tf bigint, tf_title bigint, tf_abstract bigint, first_pos bigint",
    "doc_words": "word string, stem string, tf bigint, stop boolean",
    "dw_lists": "words array<string>, tfs array<bigint>",
    "vsm_lists": "words array<string>, tfs array<bigint>",
    "top_terms": "term string, tf bigint, rank int",
    "doc_sizes": "n_a bigint, d_a bigint, n_b bigint, d_b bigint, n_c bigint, d_c bigint, n_d bigint, d_d bigint, n_e bigint, d_e bigint, max_d bigint, f_title bigint, f_abstract bigint, f_body bigint, n_v bigint, d_v bigint, max_v bigint",
}
#: Counts of words, summed or (max_) the largest; a task may give a word back several times.
PARTS = {
    "raw_parts": ("term string", ("cf", "df")),
    "word_parts": ("word string, stem string, stop boolean", ("cf", "df")),
    "term_parts": ("term string", ("n_all", "df_all", "cf", "df", "max_tf", "cf_v", "df_v", "max_v")),
    "vsm_parts": ("term string", ("cf_v", "df_v", "max_v")),
    "w_parts": ("word string", ("cf", "df")),
}
TOP = 15
_FIELDS = pa.array(["title", "abstract", "body"])
_stems: dict[str, str] = {}

#: A text with a character of this class is cut into words by Spark's own expressions; of others every byte from 128 on is
#: part of a letter, which has one small letter of its own, so that the bytes of many texts are cut at once.
OTHER = re.compile("[^\\x00-\\x7F\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u012F\\u0131-\\u017F]")
_byte = np.arange(256)
_letter = ((_byte | 32) >= 97) & ((_byte | 32) <= 122) & (_byte < 128)
_plain = _letter | ((_byte >= 48) & (_byte <= 57))
_PART_OF = {"token": _plain | (_byte >= 128), "white": ~np.isin(_byte, [9, 10, 11, 12, 13, 32]), "vector": _plain}


def cut_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, text, cut): whether a text's bytes can be cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [t is not None and (t.isascii() or OTHER.search(t) is None) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text"], pa.array(cut, pa.bool_())], names=["doc_id", "text", "cut"])

    return documents.select("doc_id", "text").mapInArrow(released(run), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, text string, cut boolean")


def listed_sql(kinds: dict[str, str], more: str = "") -> str:
    """Texts whose bytes are cut into words, and lists of words (column: expression) of the others; `more` for these too."""
    lists = "".join(f", CASE WHEN NOT cut THEN coalesce({q}, array()) END AS {c}" for c, q in kinds.items())
    return f"SELECT doc_id, CASE WHEN cut THEN text END AS text{lists}{more} FROM cut_texts"


def _stemmed(words: list[str]) -> list[str]:
    if len(_stems) > KEPT:
        _stems.clear()
    for w in words:
        if w not in _stems:
            _stems[w] = stem(w)
    return [_stems[w] for w in words]


def _numbered(items: list[str]) -> tuple[np.ndarray, list[str]]:
    """The number of each item among the distinct ones, and these."""
    seen: dict[str, int] = {}
    return np.array([seen.setdefault(x, len(seen)) for x in items], dtype=np.int64), list(seen)


def cut(texts: list[str | None], kind: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The small-letter words of texts, how many each text has, and how many stand in its first and its second line."""
    raw = [b"" if t is None else t.lower().encode() for t in texts]
    ends = np.cumsum(np.array([len(r) + 1 for r in raw], dtype=np.int64))
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    part = _PART_OF[kind][data]
    if kind == "vector":  # inner hyphens belong to a word, what stands before its first letter does not
        part[1:-1] |= (data[1:-1] == 45) & part[:-2] & part[2:]
        place = np.arange(len(data), dtype=np.int32)
        begun = np.maximum.accumulate(np.where(part & ~np.concatenate(([False], part[:-1])), place, 0))
        part &= np.maximum.accumulate(np.where(_letter[data], place, -1)) >= begun
    start = np.flatnonzero(part & ~np.concatenate(([False], part[:-1])))
    stop = np.flatnonzero(part & ~np.concatenate((part[1:], [False]))) + 1
    at = np.concatenate(([0], np.cumsum(stop - start))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(at.tobytes()), pa.py_buffer(data[part].tobytes()))
    line = np.flatnonzero(data == 10)
    k = np.searchsorted(line, np.concatenate(([0], ends[:-1])))
    first, second = line[k], np.minimum(line[np.minimum(k + 1, len(line) - 1)], ends - 1)
    before = lambda x: np.searchsorted(start, x)
    begin = before(np.concatenate(([0], ends[:-1])))
    return words, before(ends) - begin, before(first) - begin, before(second) - before(first)


class Bag:
    """The words of some documents: number of the document and of the word, place, of every token; nt and na, tokens of the first and second line."""

    def __init__(self, b: pa.RecordBatch, kind: str = "token", column: str = "w"):
        flat, lengths, self.nt, self.na = cut(b["text"].to_pylist(), kind)
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        if b[column].null_count < len(b):
            theirs = pc.fill_null(pc.list_value_length(b[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = b[column].flatten()
            self.doc = np.concatenate((self.doc, np.repeat(np.arange(len(theirs)), theirs)))
            order = np.argsort(self.doc, kind="stable")
            flat, self.doc, lengths = pa.concat_arrays([flat, words.cast(pa.string())]).take(pa.array(order)), self.doc[order], lengths + theirs
            if kind == "token" and "nt" in b.schema.names:
                of = lambda c: pc.fill_null(b[c], 0).to_numpy(zero_copy_only=False).astype(np.int64)
                self.nt, self.na = self.nt + of("nt"), self.na + of("na")
        flat = flat.dictionary_encode()
        self.words = flat.dictionary.to_pylist()
        self.code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.pos = np.arange(len(self.doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        if kind == "vector":
            number, self.words = _numbered([w.lower() for w in self.words])
            self.code = number[self.code] if len(self.code) else self.code

    def only(self, kept: list[bool]) -> Bag:
        """Tokens of the words that are kept, their places counted anew."""
        at = np.array(kept, dtype=bool)[self.code] if len(self.code) else np.zeros(0, dtype=bool)
        self.code, self.doc = self.code[at], self.doc[at]
        first = np.searchsorted(self.doc, self.doc)
        self.pos = np.arange(len(self.doc)) - first
        return self

    def groups(self, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens in the order of (document, code), where a group starts among them, and each group's document and code."""
        key = self.doc * max(1, size) + code
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1])))
        return order, start, key[start] // max(1, size), key[start] % max(1, size)

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, word and number of tokens of every pair of both."""
        size = max(1, len(self.words))
        key, n = np.unique(self.doc * size + self.code, return_counts=True)
        return key // size, key % size, n


def trained(bag: Bag) -> Bag:
    """Words that vectors are trained on: no stop words, no single letters."""
    stop = set(STOP_WORDS)
    return bag.only([len(w) > 1 and w not in stop for w in bag.words])


def _kept(bag: Bag) -> np.ndarray:
    """Which tokens are no stop words."""
    stop = set(STOP_WORDS)
    return np.array([w not in stop for w in bag.words], dtype=bool)[bag.code] if len(bag.code) else np.zeros(0, dtype=bool)


def _tok(ids: pa.Array, b: pa.RecordBatch, asked: Callable[[str], bool] | None = None) -> dict:
    """Tokens; only those of the stems that are asked for, at their places, where some are."""
    bag, stop = Bag(b), set(STOP_WORDS)
    stems = _stemmed(bag.words)
    if asked:
        at = np.array([asked(s) for s in stems], dtype=bool)[bag.code] if len(bag.code) else np.zeros(0, dtype=bool)
        bag.code, bag.doc, bag.pos = bag.code[at], bag.doc[at], bag.pos[at]
    place = (bag.pos >= bag.nt[bag.doc]).astype(np.int8) + (bag.pos >= (bag.nt + bag.na)[bag.doc])
    of = lambda rows: pa.array(rows, pa.string()).take(pa.array(bag.code))
    return {"doc_id": ids.take(pa.array(bag.doc)), "pos": bag.pos, "field": _FIELDS.take(pa.array(place)), "surface": of(bag.words), "stem": of(stems), "term": of([None if w in stop else s for w, s in zip(bag.words, stems, strict=True)])}


def _by_stem(bag: Bag) -> tuple:
    """Stems, and of every document and stem: document, stem, tokens, and of its tokens that are no stop words all, those of title and abstract, the first place."""
    number, stems = _numbered(_stemmed(bag.words))
    order, start, doc, term = bag.groups(number[bag.code] if len(bag.code) else bag.code, len(stems))
    pos, of, kept = bag.pos[order], bag.doc[order], _kept(bag)[order]
    add = lambda x: np.add.reduceat(x.astype(np.int64), start) if len(start) else np.zeros(0, dtype=np.int64)
    title, upper = pos < bag.nt[of], pos < (bag.nt + bag.na)[of]
    far = np.iinfo(np.int64).max
    first = np.minimum.reduceat(np.where(kept, pos, far), start) if len(start) else np.zeros(0, dtype=np.int64)
    return stems, doc, term, add(np.ones(len(pos))), add(kept), add(kept & title), add(kept & upper & ~title), pa.array(first, mask=first == far)


def _doc_terms(ids: pa.Array, b: pa.RecordBatch) -> dict:
    stems, doc, term, n, tf, title, abstract, first = _by_stem(Bag(b))
    return {"doc_id": ids.take(pa.array(doc)), "term": pa.array(stems, pa.string()).take(pa.array(term)), "n_all": n, "tf": tf, "tf_title": title, "tf_abstract": abstract, "first_pos": first}


def _doc_words(ids: pa.Array, b: pa.RecordBatch) -> dict:
    bag, stop = Bag(b), set(STOP_WORDS)
    doc, word, n = bag.counts()
    of = lambda rows, kind: pa.array(rows, kind).take(pa.array(word))
    return {"doc_id": ids.take(pa.array(doc)), "word": of(bag.words, pa.string()), "stem": of(_stemmed(bag.words), pa.string()), "tf": n, "stop": of([w in stop for w in bag.words], pa.bool_())}


def _lists(ids: pa.Array, words: list[str], doc: np.ndarray, word: np.ndarray, n: np.ndarray) -> dict:
    at = pa.array(np.searchsorted(doc, np.arange(len(ids) + 1)).astype(np.int32))
    return {"doc_id": ids, "words": pa.ListArray.from_arrays(at, pa.array(words, pa.string()).take(pa.array(word))), "tfs": pa.ListArray.from_arrays(at, pa.array(n))}


def _dw_lists(ids: pa.Array, b: pa.RecordBatch) -> dict:
    bag = trained(Bag(b, "vector"))
    return _lists(ids, bag.words, *bag.counts())


def _heads(b: pa.RecordBatch) -> pa.RecordBatch:
    """Documents up to the end of their second line."""
    text = pa.array([None if t is None else "\n".join(t.split("\n", 2)[:2]) for t in b["text"].to_pylist()], pa.string())
    w, counted = b["w"], "nt" in b.schema.names
    if w.null_count < len(b) and counted:
        w = pa.array([None if x is None else x[: (nt or 0) + (na or 0)] for x, nt, na in zip(*(b[c].to_pylist() for c in ("w", "nt", "na")), strict=True)], w.type)
    return pa.RecordBatch.from_arrays([text, w, *([b["nt"], b["na"]] if counted else [])], names=["text", "w", *(["nt", "na"] if counted else [])])


def head_stems(b: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Stems, and document, stem and number of every pair, of title and abstract without stop words."""
    stems, doc, term, _, _, title, abstract, _ = _by_stem(Bag(_heads(b)))
    at = title + abstract > 0
    return stems, doc[at], term[at], (title + abstract)[at]


def _vsm_lists(ids: pa.Array, b: pa.RecordBatch) -> dict:
    """The stems of title and abstract."""
    return _lists(ids, *head_stems(b))


def _top_terms(ids: pa.Array, b: pa.RecordBatch) -> dict:
    """The most frequent stems of a document, equal ones in their own order."""
    stems, doc, term, _, tf, _, _, _ = _by_stem(Bag(b))
    doc, term, tf = (x[tf > 0] for x in (doc, term, tf))
    place = np.empty(len(stems), dtype=np.int64)
    place[sorted(range(len(stems)), key=stems.__getitem__)] = np.arange(len(stems))
    order = np.lexsort((place[term], -tf, doc))
    doc, term, tf = doc[order], term[order], tf[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc) + 1
    doc, term, tf, rank = (x[rank <= TOP] for x in (doc, term, tf, rank))
    return {"doc_id": ids.take(pa.array(doc)), "term": pa.array(stems, pa.string()).take(pa.array(term)), "tf": tf, "rank": rank.astype(np.int32)}


def _doc_sizes(ids: pa.Array, b: pa.RecordBatch) -> dict:
    """Tokens and distinct ones of every document by condition, of its fields, and of title and abstract."""
    bag, size = Bag(b), len(ids)
    total = lambda doc, n: np.bincount(doc, weights=n, minlength=size).astype(np.int64)

    def most(doc: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros(size, dtype=np.int64)
        np.maximum.at(out, doc, n)
        return out

    a_doc, _, a_n = Bag(b, "white", "wa").counts()
    stop = set(STOP_WORDS)
    doc, word, n = bag.counts()
    kept = np.array([w not in stop for w in bag.words], dtype=bool)[word] if len(word) else np.zeros(0, dtype=bool)
    _, e_doc, _, e_n, tf, title, abstract, _ = _by_stem(bag)
    one = lambda doc: np.bincount(doc, minlength=size)
    v = title + abstract
    return {
        "doc_id": ids, "n_a": total(a_doc, a_n), "d_a": one(a_doc), "n_b": total(doc, n), "d_b": one(doc), "n_c": total(doc[kept], n[kept]), "d_c": one(doc[kept]),
        "n_d": total(e_doc, tf), "d_d": one(e_doc[tf > 0]), "n_e": total(e_doc, e_n), "d_e": one(e_doc), "max_d": most(e_doc, tf),
        "f_title": total(e_doc, title), "f_abstract": total(e_doc, abstract), "f_body": total(e_doc, tf - v), "n_v": total(e_doc, v), "d_v": one(e_doc[v > 0]), "max_v": most(e_doc, v),
    }


MAKERS: dict[str, Callable[[pa.Array, pa.RecordBatch], dict]] = {"tok": _tok, "doc_terms": _doc_terms, "doc_words": _doc_words, "dw_lists": _dw_lists, "vsm_lists": _vsm_lists, "top_terms": _top_terms, "doc_sizes": _doc_sizes}


def _summed(code: np.ndarray, size: int, *columns: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(code, weights=c, minlength=size).astype(np.int64) for c in columns]


def _largest(code: np.ndarray, size: int, n: np.ndarray) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    np.maximum.at(out, code, n)
    return out


def _word_counts(b: pa.RecordBatch, name: str) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words of some documents and their counts by column of PARTS."""
    if name == "term_parts":
        stems, _, term, n, tf, title, abstract, _ = _by_stem(Bag(b))
        v, one, k = title + abstract, np.ones(len(term)), len(stems)
        return stems, [*_summed(term, k, n, one, tf, tf > 0), _largest(term, k, tf), *_summed(term, k, v, v > 0), _largest(term, k, v)]
    if name == "vsm_parts":  # stems of title and abstract
        stems, _, term, v = head_stems(b)
        n, df = _summed(term, len(stems), v, np.ones(len(v)))
        at = np.flatnonzero(df)
        return [stems[i] for i in at], [n[at], df[at], _largest(term, len(stems), v)[at]]
    bag = trained(Bag(b, "vector")) if name == "w_parts" else Bag(b, "white", "wa") if name == "raw_parts" else Bag(b)
    _, word, n = bag.counts()
    cf, df = _summed(word, len(bag.words), n, np.ones(len(n)))
    at = np.flatnonzero(df)  # words that are not trained on have none
    return [bag.words[i] for i in at], [cf[at], df[at]]


class Held:
    """Counts of the words that a task has seen."""

    def __init__(self, name: str):
        self.name, self.at = name, {}
        self.largest = [c.startswith("max_") for c in PARTS[name][1]]
        self.n = np.zeros((len(self.largest), 1 << 12), dtype=np.int64)

    def add(self, words: list[str], columns: list[np.ndarray]) -> None:
        at = self.at
        place = np.array([at.setdefault(w, len(at)) for w in words], dtype=np.int64)
        while len(at) > self.n.shape[1]:
            self.n = np.concatenate((self.n, np.zeros_like(self.n)), axis=1)
        for row, largest, c in zip(self.n, self.largest, columns, strict=True):
            row[place] = np.maximum(row[place], c) if largest else row[place] + c

    def rows(self) -> Iterator[pa.RecordBatch]:
        words, stop = list(self.at), set(STOP_WORDS)
        key, columns = PARTS[self.name]
        for i in range(0, len(words), 1 << 16):
            w = words[i : i + (1 << 16)]
            own = [w, _stemmed(w), [x in stop for x in w]] if "stem" in key else [w]
            arrays = [pa.array(x, pa.bool_() if k == 2 else pa.string()) for k, x in enumerate(own)]
            arrays += [pa.array(c[i : i + len(w)]) for c in self.n]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(k.split()[0] for k in key.split(", ")), *columns])
        self.at, self.n = {}, np.zeros_like(self.n[:, : 1 << 12])


class Made(str):
    """A relation that `make` gives of a query's rows, where what it `needs` has been written before: (index, rows) to rows.

    Written, unless one relation alone reads it.
    """

    make: Callable
    needs: tuple[str, ...]
    stored: bool

    def __new__(cls, sql: str, make: Callable, needs: tuple[str, ...] = (), stored: bool = True):
        out = super().__new__(cls, sql)
        out.make, out.needs, out.stored = make, needs, stored
        return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows and, where they have texts, about so many bytes at most."""
    for b in batches:
        if "text" not in b.schema.names:
            yield from (b.slice(i, rows) for i in range(0, b.num_rows, rows))
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < b.num_rows:
            z = int(np.searchsorted(size, (size[i - 1] if i else 0) + BYTES, side="right"))
            z = min(max(z, i + 1), i + rows, b.num_rows)
            yield b.slice(i, z - i)
            i = z


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a mapInArrow, which at a task's end gives the worker's free memory back: workers are reused."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # not glibc
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def made_of(listed: DataFrame, name: str, asked: Callable[[str], bool] | None = None) -> DataFrame:
    """The rows of a kind from documents (doc_id, text, w, and wa, nt, na where they count); tokens of stems asked for alone."""
    if name in PARTS:

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Held(name)
            for b in slices(batches):
                held.add(*_word_counts(b, name))
                if len(held.at) > HELD:
                    yield from held.rows()
            yield from held.rows()

        key, columns = PARTS[name]
        return listed.mapInArrow(released(counted), ", ".join([key, *(f"{c} bigint" for c in columns)]))
    make = MAKERS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            columns = make(b["doc_id"], b, asked) if asked else make(b["doc_id"], b)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))

    return listed.mapInArrow(released(run), f"doc_id {listed.schema['doc_id'].dataType.simpleString()}, {SCHEMAS[name]}")


def tokens(name: str, sql: str) -> tuple[str, Made]:
    return name, Made(sql, lambda index, listed: made_of(listed, name))


def counts(name: str, sql: str) -> list[tuple[str, str]]:
    """A relation of PARTS, one row a word, and what the tasks give back of it, which is summed at once and not written."""
    key, columns = PARTS[name]
    keys = ", ".join(k.split()[0] for k in key.split(", "))
    total = ", ".join(f"max({c}) AS {c}" if c.startswith("max_") else f"CAST(sum({c}) AS BIGINT) AS {c}" for c in columns)
    each = f"{name}_by_task"
    return [(each, Made(sql, lambda index, listed: made_of(listed, name), stored=False)), (name, f"SELECT {keys}, {total} FROM {each} GROUP BY {keys}")]


def words_there(index, listed: DataFrame, asked: str) -> DataFrame:
    """(word, stem) of the words of a written relation that documents have, once a task."""
    wanted = frozenset(r["word"] for r in index.spark.table(index.views[asked]).collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in slices(batches):
            seen.update(wanted.intersection(Bag(b).words))
        there = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.string()), pa.array(_stemmed(there), pa.string())], names=["word", "stem"])

    return listed.mapInArrow(released(run), "word string, stem string")


def asked_for(stems: frozenset[str], prefixes: tuple[str, ...]) -> Callable[[str], bool]:
    return lambda s: s in stems or s.startswith(prefixes)
