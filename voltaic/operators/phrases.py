"""Phrase tables of any size matched in one pass (T13 places, T7 glossaries).

A phrase is a sequence of tokens. Texts are cut from left to right: at each place the longest phrase that begins there
is taken, the search goes on behind it (leftmost-longest, matches never overlap); without one, the token stands
alone. Of equal phrases the one with the smallest key counts. The phrases sit in a token trie, so a text costs about one
step per token however many phrases there are. A trie is sent to every task and therefore bounded: a larger table
is split by a hash of the phrases' first tokens into tries of about ``TRIE_PHRASES``, one pass each. All phrases that can
begin at a place are in one of them, so each pass knows the longest match at its places, and the cut is made at
the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltaic.operators.text import TOKEN_PATTERN
from voltaic.session import cut_lineage

TRIE_PHRASES = 200_000
PIECE_TOKENS = 200_000      # tokens that a task holds as Python objects: a batch of long texts has many millions
_MATCHES = pa.list_(pa.struct([("pos", pa.int32()), ("n", pa.int32()), ("key", pa.string())]))
_SQL_MATCHES = "array<struct<pos:int,n:int,key:string>>"


def token_array(text: Column, lower: bool) -> Column:
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(TOKEN_PATTERN), 0)


def build_trie(rows) -> dict:
    """Nested dictionaries by token; a phrase's key stands under None."""
    root: dict = {}
    for tokens, key in rows:
        node = root
        for t in tokens:
            node = node.setdefault(t, {})
        node[None] = min(key, node[None]) if None in node else key
    return root


def longest_at(trie: dict, tokens: list, i: int) -> tuple[int, str | None]:
    """(tokens, key) of the longest phrase at ``i``; (0, None) without one."""
    best, node, j = (0, None), trie, i
    while j < len(tokens) and (node := node.get(tokens[j])) is not None:
        j += 1
        if None in node:
            best = j - i, node[None]
    return best


def cut(tokens: list, found) -> list:
    """The matches taken from left to right; ``found(i)``: the longest at ``i``."""
    out, i = [], 0
    while i < len(tokens):
        n, key = found(i)
        if n:
            out.append({"pos": i, "n": n, "key": key})
        i += n or 1
    return out


def _render(tokens: list, matches: list) -> str:
    out, i = [], 0
    for m in matches:
        out += tokens[i:m["pos"]]
        out.append(m["key"])
        i = m["pos"] + m["n"]
    return " ".join(out + tokens[i:])


def pieces(batch):
    """``batch`` in slices of about ``PIECE_TOKENS`` tokens (a longer text stands alone)."""
    ends = np.cumsum(pa.compute.list_value_length(batch.column("_tokens")).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + PIECE_TOKENS, "right")))
        yield batch.slice(at, end - at)
        at = end


def _look_up(shared, last: bool, replace: bool):
    """Adds this trie's longest match at every place to the ones found before; the last pass cuts the text."""
    def run(batches):
        trie = shared.value
        for batch in (piece for whole in batches for piece in pieces(whole)):
            texts, before = batch.column("_tokens").to_pylist(), batch.column("_found").to_pylist()
            out = []
            for tokens, known in zip(texts, before):
                tokens = tokens or []
                if known or not last:
                    at = {m["pos"]: (m["n"], m["key"]) for m in known}
                    for i, t in enumerate(tokens):
                        if t in trie and (m := longest_at(trie, tokens, i))[0]:
                            at[i] = m
                    found = cut(tokens, lambda i: at.get(i, (0, None))) if last else [
                        {"pos": i, "n": n, "key": key} for i, (n, key) in sorted(at.items())]
                else:
                    found = cut(tokens, lambda i: longest_at(trie, tokens, i) if tokens[i] in trie else (0, None))
                out.append(_render(tokens, found) if replace and last else found)
            made = pa.array(out, pa.string() if replace and last else _MATCHES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=batch.schema.names)
    return run


def _matched(df: DataFrame, text: Column, phrases: DataFrame, phrase_col: str, key_col: str, lower: bool, replace: bool) -> DataFrame:
    spark = df.sparkSession
    table = (phrases.select(token_array(F.col(phrase_col), lower).alias("t"), F.col(key_col).cast("string").alias("key"))
             .where("size(t) > 0 and key is not null").groupBy("t").agg(F.min("key").alias("key")))
    tries = max(1, -(-table.count() // TRIE_PHRASES))
    out = df.withColumns({"_tokens": token_array(text, lower), "_found": F.array().cast(_SQL_MATCHES)})
    for b in range(tries):
        rows = table.where(F.pmod(F.xxhash64(F.col("t")[0]), F.lit(tries)) == b).collect()
        shared = spark.sparkContext.broadcast(build_trie((r.t, r.key) for r in rows))
        last = b == tries - 1
        schema = T.StructType([*out.schema.fields[:-1], T.StructField("_found", T.StringType())]) if replace and last else out.schema
        out = out.mapInArrow(_look_up(shared, last, replace), schema)
        if not last:
            out = cut_lineage(out, "phrases")
    return out


def match_phrases(df: DataFrame, text: Column, phrases: DataFrame, phrase_col: str = "phrase", key_col: str = "key",
                  lower: bool = True, out_col: str = "matches") -> DataFrame:
    """``df`` with ``out_col``, the array of matches (pos, n, key) in text order; ``pos`` counts tokens from 0. Null texts and
    texts without tokens have none; phrases that are null or hold no token match nothing."""
    return _matched(df, text, phrases, phrase_col, key_col, lower, False).drop("_tokens").withColumnRenamed("_found", out_col)


def replace_phrases(df: DataFrame, text: Column, phrases: DataFrame, out_col: str, phrase_col: str = "phrase",
                    key_col: str = "key") -> DataFrame:
    """``df`` with ``out_col``: the lower-cased tokens, every match replaced by its key, joined by single spaces (a null
    text gives an empty one)."""
    return _matched(df, text, phrases, phrase_col, key_col, True, True).drop("_tokens").withColumnRenamed("_found", out_col)
