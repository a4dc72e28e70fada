"""Byte-level BPE (1): recursive DuckDB queries merge distinct pre-tokens, ordered aggregation decodes."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain, islice

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import doc_rows, slices, spread, table

#: Characters of text taken at a time, rows of all steps of one recursive query, ids of one decoding query, letters beyond which
#: a word falls apart before it is finished, bytes of a token's edge, pieces and words that a worker remembers.
SLICE, ROWS, IDS_AT_ONCE, LONG, EDGE, PIECES, WORDS = 4_000_000, 1_500_000, 400_000, 64, 3, 500_000, 600_000
#: Letters of long words worked on together, DuckDB's bytes for each letter of one that is longer, and for all else.
LETTERS, EACH, MEMORY = 200_000, 1000, 256 << 20

MERGES = """
CREATE TABLE merges AS
SELECT l.id AS l, r.id AS r, t.id AS id
FROM (SELECT id, s, unnest(range(1, length(s))) AS i FROM vocab) t
JOIN vocab l ON l.s = substring(t.s, 1, t.i) JOIN vocab r ON r.s = substring(t.s, t.i + 1)
"""

#: One row for each token position of a word; a step contracts each word's leftmost pair of least rank.
ENCODE = """
WITH RECURSIVE state(word, pos, tok, step) AS (
  SELECT w.word, p.pos::INTEGER, v.id, 0
  FROM words w, LATERAL (SELECT unnest(range(1, length(w.s) + 1)) AS pos) p JOIN letters v ON v.s = substring(w.s, p.pos, 1)
  UNION ALL
  SELECT word, pos, CASE WHEN key = best THEN (best >> 32)::INTEGER ELSE tok END, step + 1
  FROM (
    SELECT word, pos, tok, step, key, min(key) OVER (PARTITION BY word) AS best, lag(key) OVER (PARTITION BY word ORDER BY pos) AS left_key
    FROM (
      SELECT n.word, n.pos, n.tok, n.step, (m.id::BIGINT << 32) + n.pos AS key
      FROM (SELECT *, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS next FROM state) n
      LEFT JOIN merges m ON m.l = n.tok AND m.r = n.next
    )
  )
  WHERE best IS NOT NULL AND left_key IS DISTINCT FROM best
)
SELECT s.word, string_agg(s.tok, ',' ORDER BY s.pos) AS ids
FROM state s SEMI JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) l ON l.word = s.word AND l.step = s.step
GROUP BY s.word
"""

#: The same rule for long words, whose runs of tokens (seg) are contracted side by side for at most {steps} steps. A step takes every
#: occurrence of its least pair, from the left; only the leftmost where what it makes could join a neighbour at a smaller rank.
CONTRACT = """
CREATE OR REPLACE TABLE after AS
WITH RECURSIVE run(seg, pos, tok, step) AS (
  SELECT seg, pos, tok, 0 FROM state
  UNION ALL
  SELECT seg, pos, CASE WHEN hit THEN best ELSE tok END, step + 1
  FROM (
    SELECT *, lag(hit) OVER (PARTITION BY seg ORDER BY pos) AS gone
    FROM (
      SELECT *, coalesce(made = best AND CASE WHEN tame THEN (nth - head) % 2 = 0 ELSE nth = foremost END, false) AS hit
      FROM (
        SELECT *, max(CASE WHEN made = best AND prev IS DISTINCT FROM best THEN nth END) OVER (PARTITION BY seg ORDER BY pos ROWS UNBOUNDED PRECEDING) AS head,
               min(CASE WHEN made = best THEN nth END) OVER (PARTITION BY seg) AS foremost
        FROM (
          SELECT *, min(made) OVER (PARTITION BY seg) AS best, row_number() OVER (PARTITION BY seg ORDER BY pos) AS nth, lag(made) OVER (PARTITION BY seg ORDER BY pos) AS prev
          FROM (
            SELECT n.*, m.id AS made, t.id IS NULL AS tame
            FROM (SELECT *, lead(tok) OVER (PARTITION BY seg ORDER BY pos) AS next FROM run WHERE step < {steps}) n
            LEFT JOIN merges m ON m.l = n.tok AND m.r = n.next LEFT JOIN wild t ON t.id = m.id
          )
        )
      )
    )
  )
  WHERE best IS NOT NULL AND gone IS DISTINCT FROM true
)
SELECT r.seg, r.pos, r.tok, r.step FROM run r SEMI JOIN (SELECT seg, max(step) AS step FROM run GROUP BY seg) l ON l.seg = r.seg AND l.step = r.step
"""

#: A token that makes, with some neighbour, one of a smaller rank than its own.
WILD = "CREATE TABLE wild AS SELECT l AS id FROM merges WHERE id < l UNION SELECT r FROM merges WHERE id < r"

#: Strings inside tokens. Two tokens whose edges are not together inside one can never become one: they part.
INSIDE = f"""
CREATE TABLE inside AS
SELECT DISTINCT substring(s, i, n) AS s FROM (SELECT s, unnest(range(1, length(s))) AS i FROM vocab), (SELECT unnest(range(2, {2 * EDGE + 1})) AS n)
WHERE i + n - 1 <= length(s)
"""

PART = f"""
CREATE OR REPLACE TABLE state AS
SELECT pos, tok, (sum(apart) OVER (ORDER BY pos))::INTEGER AS seg
FROM (
  SELECT a.pos, a.tok, CASE WHEN a.was IS DISTINCT FROM a.seg OR i.s IS NULL THEN 1 ELSE 0 END AS apart
  FROM (
    SELECT pos, tok, seg, lag(seg) OVER (ORDER BY pos) AS was, lag(right(v.s, {EDGE})) OVER (ORDER BY pos) || left(v.s, {EDGE}) AS s
    FROM after JOIN vocab v ON v.id = tok WHERE step = $steps
  ) a LEFT JOIN inside i ON i.s = a.s
)
"""

DECODE = "SELECT doc, string_agg(s, '' ORDER BY i) AS s FROM coded JOIN vocab USING (id) GROUP BY doc"


class Pieces(dict):
    """Ids of parts by text; what is not remembered comes from the slice at hand."""

    def __missing__(self, part: str) -> str:
        return self.more[part]


class ByteBpe:
    """Encoder and decoder of a rank file. Bytes travel in SQL as Latin-1 characters."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY >> 20}MB", "temp_directory": ""})
        self.parts = False
        self.ranks = {base64.b64decode(t): int(r) for t, r in pairs}
        vocab = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "s": [t.decode("latin-1") for t in self.ranks]})
        self.db.register("given", vocab)
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM given")
        self.db.execute("CREATE TABLE letters AS SELECT id, s FROM vocab WHERE length(s) = 1")
        self.db.execute(MERGES)
        self.pattern = regex.compile(pattern)
        self.runs = regex.compile(r"\s\s")
        self.pieces = Pieces()
        self.words: dict[str, str] = {}

    def split(self, text: str) -> list[str]:
        """Parts that can be encoded alone, without the space before all but the first.

        Where no two white spaces meet, a space belongs to the token after it. Else the pre-tokens themselves are
        returned, each behind a NUL mark, as is the first part.
        """
        if self.runs.search(text):
            return ["\0" + x for x in self.pattern.findall(text)]
        parts = text.split(" ")
        parts[0] = "\0" + parts[0]
        return parts

    def pretokens(self, part: str) -> list[str]:
        return self.pattern.findall(part[1:] if part[:1] == "\0" else " " + part)

    def merged(self, words: list[str]) -> dict[str, str]:
        """Ids of distinct pre-tokens, joined by commas. A query's words have at most ROWS rows in all its steps, or it has one word."""
        out, part, rows = {}, [], 0
        short = [(w, w.encode()) for w in words]
        self.long(out, [(w, b) for w, b in short if len(b) > LONG])
        for w, b in short:
            if len(b) > LONG:
                continue
            if part and rows + len(b) * len(b) > ROWS:
                out |= self.recursive(part)
                part, rows = [], 0
            part.append((w, b))
            rows += len(b) * len(b)
        return out | self.recursive(part)

    def recursive(self, part: list[tuple[str, bytes]]) -> dict[str, str]:
        if not part:
            return {}
        self.db.register("words", pa.table({"word": pa.array(range(len(part)), pa.int32()), "s": [b.decode("latin-1") for _, b in part]}))
        got = self.db.sql(ENCODE).to_arrow_table()
        return dict(zip((part[k][0] for k in got["word"].to_pylist()), got["ids"].to_pylist(), strict=True))

    def long(self, out: dict[str, str], words: list[tuple[str, bytes]]) -> None:
        """Words over LONG letters, LETTERS at a time, or one."""
        at = 0
        while at < len(words):
            n, size = at, 0
            while n < len(words) and (n == at or size + len(words[n][1]) <= LETTERS):
                size += len(words[n][1])
                n += 1
            out |= self.contracted(words[at:n], size)
            at = n

    def contracted(self, words: list[tuple[str, bytes]], size: int) -> dict[str, str]:
        """Contract in rounds of a bounded number of steps; after each, what is finished leaves and the rest parts further."""
        if not self.parts:
            self.db.execute(WILD)
            self.db.execute(INSIDE)
            self.parts = True
        self.db.execute(f"SET memory_limit = '{max(MEMORY, size * EACH) >> 20}MB'")
        ends = np.cumsum([len(b) for _, b in words])
        letters = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        rows = letters[np.frombuffer(b"".join(b for _, b in words), np.uint8)]
        pos = np.arange(size)
        self.db.register("given", pa.table({"pos": pos, "tok": rows, "seg": np.searchsorted(ends, pos, side="right")}))
        self.db.execute("CREATE OR REPLACE TABLE after AS SELECT seg, pos, tok, 0 AS step FROM given")
        steps, left, done = 0, size, []
        while left:
            self.db.execute(PART, {"steps": steps})
            steps = max(1, ROWS // left)
            self.db.execute(CONTRACT.format(steps=steps))
            done.append(self.db.sql(f"SELECT pos, tok FROM after WHERE step < {steps}").to_arrow_table())
            left = self.db.execute("SELECT count(*) FROM after WHERE step = $steps", {"steps": steps}).fetchone()[0]
        self.db.execute("DROP TABLE state; DROP TABLE after")
        self.db.execute(f"SET memory_limit = '{MEMORY >> 20}MB'")
        every = pa.concat_tables(done)
        order = np.argsort(pos := every["pos"].to_numpy())
        tok, where = every["tok"].to_numpy()[order], np.searchsorted(pos[order], np.concatenate(([0], ends)))
        return {w: ",".join(map(str, tok[a:z].tolist())) for (w, _), a, z in zip(words, where[:-1].tolist(), where[1:].tolist(), strict=True)}

    def encode(self, texts: list[str]) -> list[str]:
        """Each text's ids, joined by commas; an empty text has the empty string."""
        parts = [self.split(t) for t in texts]
        kept, known = self.pieces, self.words
        new = {p: self.pretokens(p) for p in set(chain.from_iterable(parts)) if p not in kept}
        words = self.merged([w for w in set(chain.from_iterable(new.values())) if w not in known])
        ids = {p: ",".join([known[w] if w in known else words[w] for w in ws]) for p, ws in new.items()}
        kept.more = ids
        out = [",".join(filter(None, map(kept.__getitem__, ps))) for ps in parts]
        kept.more = {}
        for memory, more, most in ((kept, ids, PIECES), (known, words, WORDS)):
            memory.update(islice(more.items(), max(0, most - len(memory))))
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids, which ends at `ends`; IDS_AT_ONCE of all ids go through one query."""
        out = [[] for _ in ends]
        for at in range(0, len(ids), IDS_AT_ONCE):
            top = min(at + IDS_AT_ONCE, len(ids))
            self.db.register("coded", pa.table({"doc": np.searchsorted(ends, np.arange(at, top), side="right"), "id": ids[at:top], "i": np.arange(at, top)}))
            for doc, s in self.db.execute(DECODE).fetchall():
                out[doc].append(s.encode("latin-1"))
        return [b"".join(x) for x in out]


@lru_cache(maxsize=1)
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_decode(docs: DataFrame, ranks: str, pattern: str, outputs: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with outputs, ids (array of int) and decoded (binary).

    Every whole text is encoded; a null text is empty: no ids, no bytes. Each row gets its answer, whatever its id.
    Distinct pre-tokens of a slice go through one recursive query; nothing is shuffled.
    """

    def run(batches):
        bpe = load(ranks, pattern)
        for b in batches:
            for start, texts in slices(b.column("text"), SLICE):
                joined = bpe.encode(texts)
                n = np.array([s.count(",") + 1 if s else 0 for s in joined], np.int64)
                flat = np.fromstring(",".join(filter(None, joined)), np.int32, sep=",")
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], n.cumsum())), pa.int32()), pa.array(flat))
                back = bpe.decode(flat, n.cumsum())
                cols = [b.column("doc_id").slice(start, len(texts)), pa.array(n)]
                cols += [pa.array([hashlib.sha256(s.encode()).hexdigest() for s in joined]), pa.array([hashlib.sha256(s).hexdigest() for s in back])]
                if outputs:
                    cols += [ids, pa.array(back, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * outputs
    names = [x.split()[0] for x in schema.split(", ")]
    return spread(docs.sparkSession, doc_rows(docs)).mapInArrow(run, schema)


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=False)
