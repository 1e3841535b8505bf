"""Problem 5: token budgets per source, language and domain under an existing byte-level BPE vocabulary.

The vocabulary is compiled once into an Aho-Corasick automaton of its tokens and a table of merges. A text is cut by the
tokenizer's pattern; each cut is counted in one pass over its bytes: of the tokens that the automaton finds to end at a
position, exactly one continues the encoding of what precedes it, and a pair check on the merge ranks tells which. Only
the number of tokens is kept for each position, so no identifiers are made. A cut is a word or a number, and words
repeat; each Python worker keeps the counts of the cuts it has met.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A vocabulary goes to every executor; a larger table is refused.
MOST_MERGES = 400_000
#: Cuts remembered by a worker; the memory is emptied when full. Counts do not depend on it.
CACHE = 200_000
#: Fixed value: the pattern by which the project's tokenizer cuts text.
PATTERN = r" ?[^\W\d_]+| ?\d+| ?[^\w\s]+|_+|\s+"


def printable_bytes() -> dict[str, int]:
    """The printable alphabet of byte-level tokenizers: bytes that print as themselves stay, the others follow from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A compiled vocabulary. Tokens are Latin-1 strings of bytes; ids: 0..255 the bytes, then merges by rank."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        import ahocorasick

        self.tokens: list[bytes] = [bytes([b]) for b in range(256)]
        ids = {t: i for i, t in enumerate(self.tokens)}
        self.pair: dict[tuple[int, int], int] = {}
        self.split: list[tuple[int, int]] = [(i, i) for i in range(256)]
        for a, b in merges:
            if a not in ids or b not in ids:
                raise ValueError(f"merge of an unknown piece: {a!r} {b!r}")
            if a + b in ids:
                raise ValueError(f"two merges make the same token: {a + b!r}")
            ids[a + b] = len(self.tokens)
            self.pair[ids[a], ids[b]] = len(self.tokens)
            self.split.append((ids[a], ids[b]))
            self.tokens.append(a + b)
        self.length = [len(t) for t in self.tokens]
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            # A token whose own bytes are joined otherwise first never comes out of any text.
            if i < 256 or self.compatible(*self.split[i], whole=i):
                self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()

    def compatible(self, left: int, right: int, whole: int | None = None) -> bool:
        """Whether merging never joins anything across the border of the two tokens (``whole``: before that token arises).

        The pieces that face each other at the border arise in order of rank, of equal ones the left first. Going back in
        time, the later of the two is taken apart; a pair that merges earlier than the piece taken apart last would have been joined.
        """
        known = self.fits.get((left, right)) if whole is None else None
        if known is not None:
            return known
        a, b, limit, ok = left, right, whole if whole is not None else len(self.tokens), True
        while True:
            joined = self.pair.get((a, b))
            if joined is not None and joined < limit:
                ok = False
                break
            if max(a, b) < 256:
                break
            if a > b:
                limit, a = a, self.split[a][1]
            else:
                limit, b = b + 1, self.split[b][0]
        if whole is None:
            self.fits[left, right] = ok
        return ok

    def count(self, piece: bytes) -> int:
        """Tokens of one cut."""
        n = len(piece)
        if n < 2:
            return n
        last, counts = [-1] * (n + 1), [0] * (n + 1)
        for end, tok in self.automaton.iter(piece.decode("latin-1")):
            at = end + 1
            if last[at] >= 0:
                continue
            start = at - self.length[tok]
            if start == 0 or (last[start] >= 0 and self.compatible(last[start], tok)):
                last[at], counts[at] = tok, counts[start] + 1
        return counts[n]


def merge_plainly(bpe: Bpe, piece: bytes) -> list[int]:
    """The encoding by its definition, joining the pair of lowest rank until none is left; for checks only."""
    ids = list(piece)
    while len(ids) > 1:
        best = min(range(len(ids) - 1), key=lambda i: bpe.pair.get((ids[i], ids[i + 1]), 1 << 40))
        joined = bpe.pair.get((ids[best], ids[best + 1]))
        if joined is None:
            break
        ids[best : best + 2] = [joined]
    return ids


class Tokenizer:
    """What workers receive: the merges as bytes and the cutting pattern. Compiled at first use in each worker."""

    def __init__(self, merges: list[tuple[bytes, bytes]], pattern: str = PATTERN):
        if len(merges) > MOST_MERGES:
            raise ValueError(f"more than {MOST_MERGES} merges")
        self.merges, self.pattern, self._bpe = merges, pattern, None

    def __getstate__(self) -> dict:
        return {"merges": self.merges, "pattern": self.pattern, "_bpe": None}

    @classmethod
    def from_table(cls, merges: DataFrame, pattern: str = PATTERN) -> "Tokenizer":
        """From merge_rank, left_piece, right_piece in the printable byte alphabet. The size is checked before anything is fetched."""
        rows = merges.filter("left_piece is not null and right_piece is not null").orderBy("merge_rank").limit(MOST_MERGES + 1).collect()
        table = printable_bytes()
        as_bytes = lambda s: bytes(table[c] for c in s)
        return cls([(as_bytes(r["left_piece"]), as_bytes(r["right_piece"])) for r in rows], pattern)

    @classmethod
    def from_ranks(cls, path: str, pattern: str) -> "Tokenizer":
        """From a file of base64 tokens and ranks; each token's last merge is the encoding of its bytes by lower ranks."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        merges = []
        for tok, rank in sorted(((t, r) for t, r in ranks.items() if len(t) > 1), key=lambda x: x[1]):
            parts = [tok[i : i + 1] for i in range(len(tok))]
            while len(parts) > 2:
                low = [ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
                i = min(range(len(low)), key=low.__getitem__)
                if low[i] >= rank:
                    raise ValueError(f"{tok!r} cannot be merged from lower ranks")
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            merges.append((parts[0], parts[1]))
        return cls(merges, pattern)

    def counter(self):
        """A function from text to its number of tokens; null counts 0."""
        import regex

        if self._bpe is None:
            self._bpe = Bpe(self.merges)
        bpe, cut, known = self._bpe, regex.compile(self.pattern), {}

        def count(text: str | None) -> int:
            total = 0
            for m in cut.finditer(text or ""):
                piece = m.group()
                n = known.get(piece)
                if n is None:
                    n = bpe.count(piece.encode("utf-8", "surrogatepass"))
                    if len(piece) <= 64:
                        if len(known) >= CACHE:
                            known.clear()
                        known[piece] = n
                total += n
            return total

        return count

    def column(self, text: Column) -> Column:
        """Number of tokens of a column of texts or of arrays of texts; null and empty texts have none."""
        me = self

        @F.pandas_udf("long")
        def n_tokens(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            count = me.counter()
            of = lambda x: count(x) if x is None or isinstance(x, str) else sum(count(y) for y in x)
            for s in it:
                yield s.map(of).astype("int64")

        return n_tokens(text)


def token_budget(texts: DataFrame, text_col: str, tokenizer: Tokenizer, by: dict[str, Column], id_col: str | None = None, order_col: str | None = None) -> DataFrame:
    """Cube over the slices ``by`` (name to expression): texts, tokens and characters of every combination.

    ``text_col`` is a text or an array of texts. With ``id_col``, records delivered more than once count once, as the
    delivery with the largest ``order_col`` (ties: the larger slice and counts). A dimension that a row sums over is null
    and has 1 in its ``all_<name>`` column, which tells it from the slice of records without a value.

    Texts become counts before anything is shuffled, and counts are summed on the map side, so that neither a long text
    nor a hot slice moves. Null texts count as records of no tokens; records with a null id are kept, each on its own.
    An empty table gives an empty result. Other columns are ignored.
    """
    n_chars = F.aggregate(F.col(text_col), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.length(x), F.lit(0))) if texts.schema[text_col].dataType.typeName() == "array" else F.length(text_col)
    one = F.col(id_col).cast("string") if id_col else F.lit(None).cast("string")
    counted = texts.select(*[e.alias(k) for k, e in by.items()], one.alias("_id"), (F.col(order_col) if order_col else F.lit(0)).alias("_at"), F.coalesce(n_chars, F.lit(0)).cast("long").alias("_chars"), tokenizer.column(F.col(text_col)).alias("_tokens"))
    parts = [*by, "_tokens", "_chars"]
    if id_col:
        latest = counted.filter("_id is not null").groupBy("_id").agg(F.max(F.struct("_at", *parts)).alias("_x"))
        counted = latest.select(*[F.col(f"_x.{p}").alias(p) for p in parts]).unionAll(counted.filter("_id is null").select(*parts))
    fine = counted.groupBy(*by).agg(F.count("*").alias("_n"), F.sum("_tokens").alias("_tokens"), F.sum("_chars").alias("_chars"))
    return fine.cube(*by).agg(
        *[F.grouping(c).cast("int").alias(f"all_{c}") for c in by],
        F.sum("_n").alias("n_texts"), F.sum("_tokens").alias("n_tokens"), F.sum("_chars").alias("n_chars"),
    )


def tokenizer_of(spark: SparkSession, folder: str) -> Tokenizer:
    """The project's tokenizer, from its table ``tokenizer_merges``."""
    from millrace.sources.tables import table

    return Tokenizer.from_table(table(spark, folder, "tokenizer_merges"))
