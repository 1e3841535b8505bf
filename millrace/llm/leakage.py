"""Problem 6: held-out items that appear, whole or in part, in documents.

Latent semantic retrieval, then an exact check. One pass over the documents takes their words and counts in how many
documents each word stands. Items are cut into passages, overlapping runs of words; a distributed randomised SVD of their
TF-IDF rows gives each term of the items a latent vector. Documents are cut into runs of the same length, folded into the
latent space and compared by cosine with the passages of the nearest cells of an inverted file; runs whose words are not
the items' cannot reach the threshold and are skipped by a bound on their cosine. Candidates are verified on the words
themselves by a longest-common-subsequence alignment in which names and numbers must agree and plain words may differ
about once in ten; a question that misses that by one word passes if its answer stands in the document too.

Weights, terms and latent space are those of all items, whatever their number. What goes to the workers is bounded: terms
share TERMS vectors at most, and the items' words go in blocks of BLOCK_WORDS. No document is joined with another, and
nothing about documents comes to the driver.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import spread, written

#: Words of a passage, and the step between two; any 15 words lie whole in one passage.
WIDTH, STEP = 24, 8
#: Latent dimensions, and further random directions of the sketch.
RANK, OVERSAMPLE = 128, 32
#: Least cosine of a candidate.
COSINE = 0.4
#: Cells of the inverted file that a run is compared with; there are about as many cells as passages in each.
PROBES = 8
#: Documents without the item's words that are thought added, so that in a small corpus its words are not common ones.
PRIOR = 1000
#: Buckets of hashed words, and most latent vectors; beyond it words share one.
BUCKETS, TERMS = 1 << 20, 1 << 17
#: Words of items searched at a time, about 20 MB in each worker.
BLOCK_WORDS = 400_000
#: Words that a task counts before it hands their counts on.
MOST_WORDS = 300_000
#: Words that a stretch of a context paragraph needs.
STRETCH = 15

_JSON_HEX = re.compile(r"\\u([0-9a-fA-F]{4})")
_JSON_ESC = re.compile(r"\\+[nrtbf]|\\+(?=[\"'/\\])")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_CITE = re.compile(r"\[\^?\d{1,4}\]|\(\d{1,3}\)(?=\s|$)")
_LINK = re.compile(r"\]\((?:https?:|/|#)[^)\s]*\)")
_LINE_NO = re.compile(r"(?m)^[ \t>|]*(?:L?\d{1,5}[ \t]*[:|)\]]|\d{1,4}\.)[ \t]+")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\n[ \t>|]*(?=[a-z])")
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e0fff]")
_WORD = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
_QUOTE = re.compile(r"(?<=\w)['’ʼ`´](?=\w)")


def plain(text: str) -> str:
    """Text without markup, escapes, citation and line marks and invisible characters; letter case is kept."""
    if "\\" in text:
        text = _JSON_HEX.sub(lambda m: chr(int(m.group(1), 16)), text)
        text = _JSON_ESC.sub(lambda m: " " if m.group()[-1] in "nrtbf" else "", text)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    text = _HYPHEN.sub("", text)
    text = _LINE_NO.sub(" ", text)
    text = _CITE.sub(" ", _LINK.sub("] ", text))
    return _QUOTE.sub("", text).replace("*", "").replace("’", "")


def words(text: str | None) -> list[str]:
    return [w.replace(",", "") if w[0].isdigit() else w for w in _WORD.findall(plain(text or "").casefold())]


def hard_words(text: str, common: set[str]) -> list[bool]:
    """For each word, whether it is a name or number: those stay as they are in every copy."""
    p, out = plain(text), []
    for m in _WORD.finditer(p):
        w = m.group()
        if w[0].isdigit():
            out.append(True)
        elif not w[0].isupper():
            out.append(False)
        else:
            before = p[: m.start()].rstrip(" \t\n\"'“(")
            starts = not before or before[-1] in ".!?:;"
            out.append(not (starts and w.casefold() in common))
    return out


def spans(n: int, width: int = WIDTH, step: int = STEP) -> list[tuple[int, int]]:
    """Runs of ``width`` words every ``step``; the last one ends with the text."""
    if n <= width:
        return [(0, n)] if n else []
    at = list(range(0, n - width, step)) + [n - width]
    return [(i, i + width) for i in at]


def agrees(item: list[str], hard: list[bool], doc: list[str], whole: bool, least: int = STRETCH, slack: int = 0) -> bool:
    """Whether ``doc`` holds a stretch of ``least`` words of ``item``, or all of it if ``whole``.

    Alignment of longest common subsequence kind, row by row of the item, in which plain words may be changed, dropped or
    added and names and numbers never. A stretch begins and ends with equal words and may hold one edit in ten words, one
    more from 20 words on. A whole item may hold one edit in ten words and one more (and ``slack``), at its ends too.
    """
    n, m = len(item), len(doc)
    if not n or not m:
        return False
    at: dict[str, int] = {}
    d = np.fromiter((at.setdefault(w, len(at)) for w in doc), np.int64, m)
    digit = np.fromiter((w[0].isdigit() for w in doc), bool, m)
    if whole:
        # least edits of an alignment of the first i words that ends at each word of the document, or before it
        most, step = -(-n // 10) + 1 + slack, np.concatenate([[0], np.cumsum(np.where(digit, n + 9, 1))])
        cur = np.zeros(m + 1, np.int64)
        for i in range(n):
            cost = np.where(d == at.get(item[i], -1), 0, n + 9 if hard[i] else 1)
            nxt = np.concatenate([[n + 9 if hard[i] else cur[0] + 1], cur[:-1] + cost])
            if not hard[i]:
                nxt = np.minimum(nxt, cur + 1)
            cur = step + np.minimum.accumulate(nxt - step)
            if cur.min() > most:
                return False
        return True
    need = min(least, n)
    edits = -(-need // 10) + (need >= 20)
    # words covered by the longest stretch that ends at item word i and each word of the document, by its number of edits
    prev = [np.zeros(m + 1, np.int64) for _ in range(edits + 1)]
    for i in range(n):
        same = d == at.get(item[i], -1)
        rows: list[np.ndarray] = []
        for e in range(edits + 1):
            new = np.zeros(m + 1, np.int64)
            new[1:] = np.where(same, prev[e][:-1] + 1, 0)
            if e:
                less = prev[e - 1]
                if not hard[i]:
                    new[1:] = np.maximum(new[1:], np.where(~same & (less[:-1] > 0), less[:-1] + 1, 0))
                    new[1:] = np.maximum(new[1:], np.where(less[1:] > 0, less[1:] + 1, 0))
                new[1:] = np.maximum(new[1:], np.where(digit, 0, rows[e - 1][:-1]))
            rows.append(new)
            if (same & (new[1:] >= need)).any():
                return True
        prev = rows
    return False


class Weights:
    """Weights of words by their bucket: the squared logarithm of rarity, so that common words count little but not nothing."""

    def __init__(self, n_docs: int, buckets: np.ndarray, counts: np.ndarray):
        top = float(np.log(n_docs + PRIOR))
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[buckets] = np.arange(len(buckets), dtype=np.int32) % TERMS
        self.weight = np.zeros(BUCKETS, np.float32)
        self.weight[buckets] = np.log((n_docs + PRIOR) / (counts + 1.0)) ** 2 / top + 0.01
        self.terms = int(min(len(buckets), TERMS))
        self.other = 0.75 * top  # of a word that no item has
        self._known: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def of(self, toks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the words among the latent vectors (-1: no item has it), their weights, and weights of the others."""
        known = self._known
        if len(known) > MOST_WORDS:
            known.clear()
        b = np.empty(len(toks), np.int64)
        for i, w in enumerate(toks):
            k = known.get(w)
            if k is None:
                k = known[w] = bucket(w)
            b[i] = k
        at = self.place[b]
        outside = np.fromiter((self.other if len(w) > 3 else 0.0 for w in toks), np.float32, len(toks))
        return at, np.where(at >= 0, self.weight[b], 0).astype(np.float32), np.where(at >= 0, 0, outside)


def bucket(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) % BUCKETS


def _read(docs: DataFrame) -> DataFrame:
    """One pass: id and words (joined by spaces) of every text, and rows of ``b``, ``n``: documents with a word of that bucket.

    The row of bucket -1 counts the documents. A task adds up its counts before it hands them on.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, where = Counter(), {}
        for b in batches:
            rows = []
            for i, t in zip(b["_id"], b["_text"]):
                toks = words(t)
                rows.append((i, " ".join(toks)))
                seen[-1] += 1
                mine = set()
                for w in set(toks):
                    k = where.get(w)
                    if k is None:
                        if len(where) > MOST_WORDS:
                            where.clear()
                        k = where[w] = bucket(w)
                    mine.add(k)
                seen.update(mine)
            yield pd.DataFrame(rows, columns=["_id", "words"]).assign(b=None, n=None)
            if len(seen) > MOST_WORDS:
                yield pd.DataFrame({"_id": None, "words": None, "b": list(seen), "n": list(seen.values())})
                seen = Counter()
        if seen:
            yield pd.DataFrame({"_id": None, "words": None, "b": list(seen), "n": list(seen.values())})

    return written(docs.mapInPandas(part, docs.select("_id").schema.add("words", "string").add("b", "long").add("n", "long")), "words")


def _weights(read: DataFrame, items: DataFrame) -> tuple[Weights, set[str]]:
    """Weights of the items' words, and the plain ones among them: those in more than one of 500 documents.

    At most BUCKETS rows come to the driver, and of the words as such only those of that share, which at most 500 times the
    words of a document can have.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["_text"]:
                yield pd.DataFrame({"word": sorted(set(words(t)))}).assign(b=lambda x: x["word"].map(bucket))

    mine = written(items.mapInPandas(part, "word string, b long").distinct(), "terms")
    counts = read.filter("b is not null").groupBy("b").agg(F.sum("n").alias("n"))
    n = counts.filter("b = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = written(mine.join(counts, "b", "left").select("word", "b", F.coalesce("n", F.lit(0)).alias("n")), "weights")
    rows = found.groupBy("b").agg(F.max("n").alias("n")).orderBy("b").toPandas()
    common = {r["word"] for r in found.filter(F.col("n") > 0.002 * n).select("word").toLocalIterator()}
    return Weights(n, rows["b"].to_numpy(np.int64), rows["n"].to_numpy(np.float64)), common


def randomised_svd(rows: DataFrame, n_terms: int, rank: int = RANK, oversample: int = OVERSAMPLE, seed: int = 11) -> np.ndarray:
    """Right singular vectors (terms x rank) of a sparse matrix of rows (at array<int>, w array<float>), distributed.

    Each task sketches its rows, Y = A Omega, with a test matrix made from the seed where it is needed, and hands on its
    part of Y'Y, k x k, and of Y'A, one row a term that it met; the latter are added up where their term sends them. The
    driver gets one row a term and one small matrix a task, makes an orthonormal basis Q of Y (by Cholesky) and B = Q'A,
    whose small decomposition ends the job. An all-zero or empty matrix gives zeros.
    """
    k = rank + oversample

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        omega = np.random.default_rng(seed).standard_normal((n_terms, k)).astype(np.float32)
        gram, ya = np.zeros((k, k)), {}
        for b in batches:
            for at, w in zip(b["at"], b["w"]):
                at, w = np.asarray(at, np.int64), np.asarray(w, np.float32)
                y = w @ omega[at]
                gram += np.outer(y, y)
                for t, x in zip(at.tolist(), w):
                    if t in ya:
                        ya[t] += x * y
                    else:
                        ya[t] = x * y
        yield pd.DataFrame({"term": [-1, *ya], "block": [gram.tobytes(), *(v.astype(np.float32).tobytes() for v in ya.values())]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for t, raw in zip(b["term"], b["block"]):
                v = np.frombuffer(raw, np.float64 if t < 0 else np.float32)
                sums[t] = sums[t] + v if t in sums else v
        yield pd.DataFrame({"term": list(sums), "block": [v.tobytes() for v in sums.values()]})

    gram, ya = np.zeros((k, k)), np.zeros((n_terms, k), np.float32)
    kind = "term int, block binary"
    for r in rows.mapInPandas(part, kind).repartition("term").mapInPandas(add, kind).toLocalIterator():
        if r["term"] < 0:
            gram += np.frombuffer(bytes(r["block"]), np.float64).reshape(k, k)
        else:
            ya[r["term"]] = np.frombuffer(bytes(r["block"]), np.float32)
    val, vec = np.linalg.eigh(gram)
    ok = val > max(1e-9, val.max(initial=0) * 1e-9)
    if not ok.any():
        return np.zeros((n_terms, 1), np.float32)
    b = (ya @ (vec[:, ok] / np.sqrt(val[ok]))).astype(np.float64)  # terms x k: B'
    left, s, _ = np.linalg.svd(b, full_matrices=False)
    return left[:, s > s.max() * 1e-6][:, :rank].astype(np.float32)


def _passages(items: DataFrame, weights: Weights) -> DataFrame:
    """at, w: the weighted terms of every passage, each of length 1."""
    sent = items.sparkSession.sparkContext.broadcast(weights)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["_text"]:
                at, w, _ = sent.value.of(words(t))
                for x, y in spans(len(at)):
                    size = float(np.linalg.norm(w[x:y]))
                    if size > 0:
                        rows.append((at[x:y].tolist(), (w[x:y] / size).tolist()))
            yield pd.DataFrame(rows, columns=["at", "w"])

    return items.mapInPandas(part, "at array<int>, w array<float>")


@dataclass
class Block:
    """Held-out texts as the workers need them, with the inverted file of their passages."""

    ids: list[str]
    kinds: list[bool]  # True: to be contained whole
    texts: list[list[str]]
    hard: list[list[bool]]
    answers: list[str]
    weights: Weights
    vectors: np.ndarray  # terms x rank
    owner: np.ndarray  # text of each passage, by cell
    latent: np.ndarray  # passages x rank, of length 1, by cell
    centres: np.ndarray
    starts: np.ndarray  # first passage of each cell


def cells_of(latent: np.ndarray, seed: int = 3, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Centres of about the root of so many cells (spherical k-means on at most 50 rows a cell), and the cell of each row."""
    n = max(1, int(np.sqrt(len(latent))))
    rng = np.random.default_rng(seed)
    some = latent[rng.permutation(len(latent))[: 50 * n]]
    centres = some[rng.permutation(len(some))[:n]]
    for _ in range(rounds):
        cell = np.argmax(some @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, some)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-9), centres)
    return centres.astype(np.float32), np.concatenate([np.argmax(latent[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(latent), 4096)] or [np.empty(0, np.int64)])


def _block(rows: list, weights: Weights, vectors: np.ndarray, common: set[str]) -> Block:
    texts = [words(r["_text"]) for r in rows]
    owner, latent = [], []
    for k, toks in enumerate(texts):
        at, w, _ = weights.of(toks)
        for a, b in spans(len(toks)):
            v = w[a:b] @ vectors[at[a:b]]
            size = float(np.linalg.norm(v))
            if size > 0:
                owner.append(k)
                latent.append(v / size)
    lat = np.asarray(latent, np.float32).reshape(-1, vectors.shape[1])
    centres, cell = cells_of(lat)
    order = np.argsort(cell, kind="stable")
    starts = np.searchsorted(cell[order], np.arange(len(centres) + 1))
    return Block(
        [r["_id"] for r in rows], [bool(r["_whole"]) for r in rows], texts, [hard_words(r["_text"], common) for r in rows], [" ".join(words(r["_answer"])) for r in rows],
        weights, vectors, np.asarray(owner, np.int64)[order], lat[order], centres, starts,
    )


def _near(v: np.ndarray, p: Block, least: float, probes: int) -> Iterator[tuple[int, int]]:
    """Row of v and text of each passage with a cosine of at least ``least`` in the cells nearest to the row."""
    n = min(probes, len(p.centres))
    near = np.argpartition(-(v @ p.centres.T), n - 1, axis=1)[:, :n] if n < len(p.centres) else np.tile(np.arange(n), (len(v), 1))
    order = np.argsort(near, axis=None, kind="stable")
    cell, row = near.ravel()[order], order // n
    edge = np.searchsorted(cell, np.arange(len(p.centres) + 1))
    for c in np.unique(cell):
        a, b = p.starts[c], p.starts[c + 1]
        if b > a:
            mine = row[edge[c] : edge[c + 1]]
            r, k = np.nonzero(v[mine] @ p.latent[a:b].T >= least)
            yield from zip(mine[r].tolist(), p.owner[a + k].tolist())


def candidates_of(docs: list[list[str]], p: Block, least: float, probes: int = PROBES) -> list[dict[int, list[int]]]:
    """For each document, text number to the starts of the runs that are close to one of the text's passages."""
    found: list[dict[int, list[int]]] = [{} for _ in docs]
    if not len(p.latent):
        return found
    vecs, at_run = [], []

    def compare() -> None:
        for r, k in _near(np.asarray(vecs, np.float32), p, least, probes):
            d, start = at_run[r]
            found[d].setdefault(k, []).append(start)
        vecs.clear()
        at_run.clear()

    for d, toks in enumerate(docs):
        at, w, outside = p.weights.of(toks)
        inside, all_ = np.concatenate([[0], np.cumsum(w.astype(np.float64) ** 2)]), np.concatenate([[0], np.cumsum(outside.astype(np.float64) ** 2)])
        for a, b in spans(len(toks)):
            mine, rest = inside[b] - inside[a], all_[b] - all_[a]
            # The cosine is at most the share of the run's length that lies in the items' terms.
            if mine <= 0 or (share := np.sqrt(mine / (mine + rest))) < least:
                continue
            v = w[a:b] @ p.vectors[at[a:b]]
            size = float(np.linalg.norm(v))
            if size > 0:
                vecs.append(v * (share / size))
                at_run.append((d, a))
        if len(vecs) >= 2048:
            compare()
    if vecs:
        compare()
    return found


def holds(toks: list[str], p: Block, k: int, starts: list[int], answered: bool = False) -> bool:
    """Whether the document's words around the given runs hold text k; a whole one may miss a word more if its answer is there."""
    item, n = p.texts[k], len(p.texts[k])
    edge = n + n // 5 + 4
    zones: list[list[int]] = []
    for s in sorted(set(starts)):
        lo, hi = max(0, s - edge), min(len(toks), s + WIDTH + edge)
        if zones and lo <= zones[-1][1]:
            zones[-1][1] = max(zones[-1][1], hi)
        else:
            zones.append([lo, hi])
    slack = int(answered and p.kinds[k])
    # A common subsequence is no longer than the words in common.
    need = n - (-(-n // 10) + 1 + slack) if p.kinds[k] else min(STRETCH, n) - 3
    mine = Counter(item)
    return any(sum((mine & Counter(toks[x:y])).values()) >= need and agrees(item, p.hard[k], toks[x:y], p.kinds[k], slack=slack) for x, y in zones)


def leaked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: int = RANK, least: float = COSINE, verify: bool = True, probes: int = PROBES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(document id, item_id, has_answer): documents and the held-out items that they contain.

    items: item_id, text, whole (whether all of the text must be contained, or a stretch of 15 words is enough) and
    answer. ``has_answer`` tells whether the answer's words stand in the document too. With ``verify`` off the candidates
    of the latent search come out, for measuring its recall. ``block_words`` changes the memory that is used, not the rows.

    Null, empty and blank texts hold nothing and are contained nowhere; null ids of documents are kept as null. Equal
    documents are reported each. Texts are read whole. Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    src = spread(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull()))
    held = items.select(F.col("item_id").alias("_id"), F.col("text").alias("_text"), F.col("whole").alias("_whole"), F.col("answer").alias("_answer")).filter("_text is not null and trim(_text) <> ''")
    schema = docs.select(F.col(id_col).alias(id_col)).schema.add("item_id", "string").add("has_answer", "boolean")
    held = written(held, "items")
    read = _read(src)
    weights, common = _weights(read, held)
    vectors = randomised_svd(_passages(held, weights), max(1, weights.terms), rank)

    def search(rows: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(_block(rows, weights, vectors, common))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q = sent.value
            for b in batches:
                got: list[tuple] = []
                texts = [t.split() for t in b["words"]]
                for doc, toks, near in zip(b["_id"], texts, candidates_of(texts, q, least, probes)):
                    found: dict[str, bool] = {}
                    spoken = f" {' '.join(toks)} " if near else ""
                    for k, starts in near.items():
                        if q.ids[k] not in found:
                            answered = bool(q.answers[k]) and f" {q.answers[k]} " in spoken
                            if not verify or holds(toks, q, k, starts, answered):
                                found[q.ids[k]] = answered
                    got.extend((doc, i, a) for i, a in found.items())
                yield pd.DataFrame(got, columns=[id_col, "item_id", "has_answer"])

        return read.filter("words is not null").select("_id", "words").mapInPandas(part, schema)

    out, block, size = [], [], 0
    for r in held.orderBy("_id", "_text").toLocalIterator():
        if size >= block_words and r["_id"] != block[-1]["_id"]:  # the texts of one item stay together
            out.append(search(block))
            block, size = [], 0
        block.append(r)
        size += len(r["_text"].split())
    if block:
        out.append(search(block))
    if not out:
        return spark.createDataFrame([], schema)
    return functools.reduce(DataFrame.unionAll, out)
