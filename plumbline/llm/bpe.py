"""Byte-level BPE encoding and decoding by recursive queries of DuckDB in each partition.

The distinct words of a batch (matches of the splitting pattern) go into one recursive query. Every
round unfolds the words that still change into rows (word, position, pair of tokens), joins them
with the merge table, and contracts each word's leftmost pair of least rank, until no pair is left.
A sequence of tokens is held as a string with one private-use character a token, which DuckDB can
unfold, cut and contract without a sort. Decoding unfolds it again, joins the vocabulary and
aggregates the bytes in order. Documents are then put together from their words.

Where one merge alone makes a token, and no token of a lower rank starts or ends with it, contracting
one occurrence can't bring forth a pair that comes before the next occurrence; a round then contracts
all occurrences from left to right, which gives the same tokens in fewer rounds.

Tokens are the encoding of their bytes if each two neighbours are the encoding of theirs. So a very long
word goes through the query in pieces, and where two pieces meet the tokens around the seam are coded
anew, ever more of them until both ends fit what stays.
"""

from __future__ import annotations

import base64
import gc
import sys
import types
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_columns, text_bytes

#: Token i is the character of this code point plus i: private use, so nothing joins or normalizes it.
OFFSET = 0xF0000
#: Pieces and words kept with their tokens by one worker (some 300 bytes each); beyond that the cache starts anew.
CACHE = 1_500_000
#: Characters of a text handled at once, bytes of text to a result batch, and characters of words in one query.
SEGMENT, PORTION, QUERY = 1 << 20, 2 << 20, 1 << 20

#: Words of more bytes are coded in pieces of so many; tokens on either side of a seam that are coded anew, to begin with.
LONG, SEAM = 512, 12

#: k packs rank, whether all occurrences may go at once, and position, so that its minimum is the leftmost best pair.
#: The keyed recursion holds one row a word; the round number makes each changed word new to the next round.
ENCODE = f"""
WITH RECURSIVE t(word, seq, round) USING KEY (word) AS (
  SELECT word, seq, 0 FROM words
  UNION
  SELECT word,
         CASE WHEN (k >> 32) & 1 = 1
              THEN replace(seq, substr(seq, (k & 4294967295) + 1, 2), chr(({OFFSET} + (k >> 33))::INT))
              ELSE left(seq, k & 4294967295) || chr(({OFFSET} + (k >> 33))::INT) || substr(seq, (k & 4294967295) + 3)
         END,
         round + 1
  FROM (
    SELECT word, any_value(seq) AS seq, any_value(round) AS round, min(m.key + pos) AS k
    FROM (
      SELECT word, seq, round, unnest(l) || unnest(l[2:]) AS pair, unnest(range(len(l))) AS pos
      FROM (SELECT *, string_split(seq, '') AS l FROM t)
    ) JOIN merges m USING (pair)
    GROUP BY word
  )
)
SELECT word, seq FROM t
"""
DECODE = """
SELECT word, seq, hex FROM coded JOIN (
  SELECT word, string_agg(v.hex, '' ORDER BY pos) AS hex
  FROM (SELECT word, unnest(l) AS tok, unnest(range(len(l))) AS pos FROM (SELECT word, string_split(seq, '') AS l FROM coded))
  JOIN vocabulary v USING (tok) GROUP BY word
) USING (word)
"""


class Vocabulary:
    """Tokens of a rank file (base64 and rank a line) and the merges between them."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        ranks = self.ranks
        least: dict[bytes, int] = {}  # of the longer tokens that start or end with a token
        merges = []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = token[:k], token[k:]
                for part in (a, b):
                    if rank < least.get(part, 1 << 60):
                        least[part] = rank
                if a in ranks and b in ranks:
                    merges.append((ranks[a], ranks[b], rank, token))
        ways = Counter(m[2] for m in merges)
        self.pairs = [chr(OFFSET + a) + chr(OFFSET + b) for a, b, _, _ in merges]
        self.keys = [(2 * r + (ways[r] == 1 and least.get(t, 1 << 60) > r)) << 32 for _, _, r, t in merges]


class Coder:
    """Encodes and decodes words with one DuckDB connection of one thread."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        self.find = regex.compile(pattern).findall
        self.query = QUERY
        vocabulary = Vocabulary(path)
        self.ranks = vocabulary.ranks
        self.raw = {rank: token for token, rank in self.ranks.items()}
        self.first = np.array([OFFSET + self.ranks[bytes([i])] for i in range(256)], "<u4")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        tokens = list(self.ranks.items())
        for name, given in (
            ("merges", {"pair": vocabulary.pairs, "key": vocabulary.keys}),
            ("vocabulary", {"tok": [chr(OFFSET + r) for _, r in tokens], "hex": [t.hex() for t, _ in tokens]}),
        ):
            self.db.register("given", pa.table(given))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.pieces: tuple[dict, dict] = ({}, {})  # at the start of a text, and after a space
        self.odd: tuple[set, set] = (set(), set())  # pieces that can't be split alone

    def learn(self, words: list[str]) -> None:
        """Encode and decode new distinct words, portion by portion."""
        long = [w for w in words if len(w) > LONG // 4 and len(w.encode("utf-8", "surrogateescape")) > LONG]
        for word in long:
            self._learn_long(word)
        portion, size = [], 0
        for word in set(words).difference(long) if long else words:
            portion.append(word)
            size += len(word)
            if size >= self.query:
                self._code(portion)
                portion, size = [], 0
        if portion:
            self._code(portion)

    def _code(self, portion: list[str]) -> None:
        raws = [word.encode("utf-8", "surrogateescape") for word in portion]
        every = self.first[np.frombuffer(b"".join(raws), np.uint8)].tobytes().decode("utf-32-le")
        given, at = [], 0
        for raw in raws:  # a word that is a token is that token
            rank = self.ranks.get(raw)
            given.append(every[at : at + len(raw)] if rank is None else chr(OFFSET + rank))
            at += len(raw)
        self.db.register("words", pa.table({"word": np.arange(len(portion), dtype=np.int32), "seq": given}))
        coded = self.db.sql(ENCODE).to_arrow_table()
        self.db.register("coded", coded)
        decoded = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("words")
        self.db.unregister("coded")
        seqs, texts = decoded["seq"].to_pylist(), decoded["hex"].to_pylist()
        ids = (np.frombuffer("".join(seqs).encode("utf-32-le"), "<u4") - np.uint32(OFFSET)).tobytes()
        text = bytes.fromhex("".join(texts))
        i = t = 0
        for k, seq, hexed in zip(decoded["word"].to_pylist(), seqs, texts):
            j, u = i + 4 * len(seq), t + len(hexed) // 2
            self.words[portion[k]] = (ids[i:j], text[t:u])
            i, t = j, u

    def _ids(self, raws: list[bytes]) -> list[np.ndarray]:
        """Token ids of byte strings that are coded as they are, however long."""
        names = [raw.decode("utf-8", "surrogateescape") for raw in raws]
        new, size = [], 0
        for name in dict.fromkeys(n for n in names if n not in self.words):
            new.append(name)
            size += len(name)
            if size >= self.query:
                self._code(new)
                new, size = [], 0
        if new:
            self._code(new)
        return [np.frombuffer(self.words[name][0], "<u4") for name in names]

    def _learn_long(self, word: str) -> None:
        """Pieces of a long word are coded, then joined in pairs until one is left."""
        raw = word.encode("utf-8", "surrogateescape")
        parts = self._ids([raw[k : k + LONG] for k in range(0, len(raw), LONG)])
        while len(parts) > 1:
            odd = parts[-1:] if len(parts) % 2 else []
            parts = self._joined(list(zip(parts[::2], parts[1::2]))) + odd
        ids = parts[0]
        rows = [ids[k : k + LONG] for k in range(0, len(ids), LONG)]
        seqs = [(row + np.uint32(OFFSET)).astype("<u4").tobytes().decode("utf-32-le") for row in rows]
        self.db.register("coded", pa.table({"word": np.arange(len(seqs), dtype=np.int32), "seq": seqs}))
        found = dict((k, text) for k, _, text in self.db.sql(DECODE).fetchall())
        self.db.unregister("coded")
        self.words[word] = (ids.astype("<u4").tobytes(), bytes.fromhex("".join(found[k] for k in range(len(seqs)))))

    def _joined(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The tokens of each two neighbouring stretches as one."""
        raw, done = self.raw, [None] * len(pairs)
        left = {k: SEAM for k in range(len(pairs))}
        while left:
            cuts = {k: (max(len(pairs[k][0]) - n, 0), min(n, len(pairs[k][1]))) for k, n in left.items()}
            middles = self._ids([b"".join([raw[t] for t in (*pairs[k][0][a:].tolist(), *pairs[k][1][:b].tolist())]) for k, (a, b) in cuts.items()])
            seams = []  # neighbours where the middle meets what stays
            for (k, (a, b)), middle in zip(cuts.items(), middles):
                x, y = pairs[k]
                seams += [(k, int(x[a - 1]), int(middle[0]))] if a else []
                seams += [(k, int(middle[-1]), int(y[b]))] if b < len(y) else []
            coded = self._ids([raw[i] + raw[j] for _, i, j in seams])
            bad = {k for (k, i, j), ids in zip(seams, coded) if ids.tolist() != [i, j]}
            for (k, (a, b)), middle in zip(cuts.items(), middles):
                if k in bad:
                    left[k] *= 4
                else:
                    done[k] = np.concatenate((pairs[k][0][:a], middle, pairs[k][1][b:]))
                    del left[k]
        return done

    def _learn_pieces(self, first: set[str], others: set[str]) -> None:
        """Split new pieces into words, learn those, and keep the pieces' tokens.

        A piece is odd where white space meets a space at its ends: there the pattern looks
        beyond the piece, and the text has to be matched as a whole.
        """
        split, find = [], self.find
        for known, odd, pieces, lead in zip(self.pieces, self.odd, (first, others), ("", " ")):
            for piece in pieces - odd:
                if piece[-1:].isspace() or (lead and (not piece or piece[0].isspace())):
                    odd.add(piece)
                else:
                    split.append((known, piece, find(lead + piece)))
        new = {w for _, _, words in split for w in words if w not in self.words}
        self.learn(list(new))
        for known, piece, words in split:
            if len(words) == 1:
                known[piece] = self.words[words[0]]
            else:
                got = [self.words[w] for w in words]
                known[piece] = (b"".join([x[0] for x in got]), b"".join([x[1] for x in got]))

    def code(self, texts: list[str], cache: int = CACHE) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, decoded bytes) of each text."""
        if len(self.pieces[1]) + len(self.words) > cache:
            self.forget()
        start, after = self.pieces
        cut, first, others = [], set(), set()
        for text in texts:
            pieces = [p for s in _segments(text) for p in s.split(" ")]
            got = [start.get(pieces[0]), *map(after.get, islice(pieces, 1, None))]
            new = [i for i, x in enumerate(got) if x is None]
            others.update([pieces[i] for i in new if i])
            if new[:1] == [0]:
                first.add(pieces[0])
            cut.append((pieces, got, new))
        self._learn_pieces(first, others)
        ids, decoded, out = itemgetter(0), itemgetter(1), []
        for text, (pieces, got, new) in zip(texts, cut):
            for i in new:
                got[i] = (after if i else start).get(pieces[i])
            if any(got[i] is None for i in new):  # an odd piece
                words = self.find(text)
                self.learn([w for w in set(words) if w not in self.words])
                got = list(map(self.words.__getitem__, words))
            out.append((b"".join(map(ids, got)), b"".join(map(decoded, got))))
        return out


def _segments(text: str) -> list[str]:
    """``text`` cut at single spaces between words, which go; few texts are longer than one segment."""
    if len(text) <= SEGMENT:
        return [text]
    out, at = [], 0
    while len(text) - at > SEGMENT:
        k = text.find(" ", at + SEGMENT)
        while k > 0 and (text[k - 1].isspace() or text[k + 1 : k + 2].isspace() or k + 1 == len(text)):
            k = text.find(" ", k + 1)
        if k < 0:
            break
        out.append(text[at:k])
        at = k + 1
    return [*out, text[at:]]


def coder(path: str, pattern: str) -> Coder:
    """The worker process's coder, kept from task to task: the vocabulary takes seconds to load."""
    shelf = sys.modules.setdefault("_bpe_coders", types.ModuleType("_bpe_coders")).__dict__
    if (path, pattern) not in shelf:
        shelf[path, pattern] = Coder(path, pattern)
    return shelf[path, pattern]


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    text: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    cache: int = CACHE,
    portion: int = PORTION,
    query: int = QUERY,
) -> DataFrame:
    """The columns ``carry``, ``ids`` and ``decoded`` for every whole text of ``docs``.

    ``ids`` is binary: token ids as little-endian unsigned 32-bit integers, as the ranks of the
    vocabulary at ``path`` give them for each match of ``pattern``, without special tokens.
    ``decoded`` holds the bytes that those ids stand for. Null and empty texts have no ids. Rows
    that repeat each get a result; other columns of ``docs`` are ignored. ``cache`` bounds the words a
    worker keeps, ``portion`` the bytes of text handled at once and ``query`` the characters of new
    words in one query; less takes less memory and more time, with the same tokens.
    """
    fields = [docs.schema[c] for c in carry]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "ids binary", "decoded binary"])
    n = len(carry)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = coder(path, pattern)
        own.query = query
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size, first = [], 0, at
                while at < batch.num_rows and size < portion:
                    raw = batch.column(n)[at].as_py()
                    texts.append(raw.decode("utf-8", "surrogateescape"))
                    size += len(raw)
                    at += 1
                gc.disable()  # the caches hold no cycles, and walking them took a tenth of the time
                try:
                    coded = own.code(texts, cache)
                finally:
                    gc.enable()
                columns = {c: batch.column(i).slice(first, at - first) for i, c in enumerate(carry)}
                yield columns | {"ids": [x[0] for x in coded], "decoded": [x[1] for x in coded]}

    return map_columns(docs, [*(F.col(f"`{c}`") for c in carry), text_bytes(text).alias("__bytes")], ddl, body)


def decode(coded: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``carry`` and ``decoded`` (binary) for rows with a column of ids as ``encode`` returns them.

    Token rows (row, position, id) join the vocabulary, and bytes are aggregated in order. Nulls
    decode to no bytes.
    """
    fields = [coded.schema[c] for c in carry]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "decoded binary"])
    n = len(carry)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = coder(path, "")
        for batch in batches:
            seqs = [
                (np.frombuffer(x.as_py() or b"", "<u4") + np.uint32(OFFSET)).tobytes().decode("utf-32-le")
                for x in batch.column(n)
            ]
            out = [b""] * len(seqs)
            for at in range(0, len(seqs), 256):
                part = seqs[at : at + 256]
                own.db.register("coded", pa.table({"word": np.arange(len(part), dtype=np.int32), "seq": part}))
                found = own.db.sql(DECODE).fetchall()
                own.db.unregister("coded")
                for k, _, text in found:
                    out[at + k] = bytes.fromhex(text)
            yield {c: batch.column(i) for i, c in enumerate(carry)} | {"decoded": out}

    return map_columns(coded, [*(F.col(f"`{c}`") for c in carry), F.col(ids)], ddl, body)
