"""Quality rules with suffix-array repetition.

Words are runs of anything but ASCII white space. For a batch of texts one suffix array over word numbers is built by
prefix doubling, where words of different texts never match; suffixes that are already alone drop out of later rounds.
Longest common prefixes of neighbours come from the ranks of the rounds, largest stride first. Of each suffix the larger
of its two common prefixes is the longest repeat that begins there; spans of at least LEAST_REPEAT words make up the
covered share.

A document is rejected by the base rules (under 20 words, or over 30 % of its words in 8-word windows that occur twice or
more), or by the method: covered share over MOST_COVERED, or a repeat of over LONGEST_REPEAT words.

Defined cases: a null text has no words and fails; a text of white space alone likewise; long texts are read whole;
repeated rows are judged alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import arrow

BASE_WINDOW = 8
LEAST_REPEAT, MOST_COVERED, LONGEST_REPEAT = 16, 0.25, 200
_BLANKS, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def repeats(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document: words in repeated 8-word windows, words in repeats of LEAST_REPEAT words, the longest repeat."""
    sizes = np.array([len(w) for w in docs], np.int64)
    n = int(sizes.sum() + len(docs))
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    words = np.empty(n, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    for i, own in enumerate(docs):
        words[starts[i] : starts[i + 1] - 1] = [number(w, len(numbers)) for w in own]
    doc = np.repeat(np.arange(len(docs)), sizes + 1)
    key = doc * (len(numbers) + 1) + words
    ends = starts[1:] - 1
    key[ends] = (len(docs) + 1) * (len(numbers) + 1) + np.arange(len(docs))  # each document's end is a word of its own
    order = np.argsort(key, kind="stable")
    ranks = _ranks(key[order], order, np.zeros(n, np.int64), np.zeros(n, np.int64))
    active = _tied(ranks, order)
    stride, levels = 1, [(1, ranks)]
    eight = longest = np.zeros(n, np.int64)
    suffixes = order[:0]
    while len(active):
        second = ranks[np.minimum(active + stride, n - 1)]
        first = ranks[active]
        by = np.lexsort((second, first))
        active, first, second = active[by], first[by], second[by]
        fresh = ranks.copy()
        begins = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        groups = np.concatenate([[True], first[1:] != first[:-1]])
        at = np.arange(len(active))
        offset = np.maximum.accumulate(np.where(begins, at, 0)) - np.maximum.accumulate(np.where(groups, at, 0))
        fresh[active] = first + offset
        stride, ranks = 2 * stride, fresh
        levels.append((stride, ranks))
        if stride == BASE_WINDOW:
            eight = np.zeros(n + 1, np.int64)
            suffixes = _tied(ranks, active)
            np.add.at(eight, suffixes, 1)
            np.add.at(eight, suffixes + BASE_WINDOW, -1)
            eight = (np.cumsum(eight)[:n] > 0).astype(np.int64)
        active = _tied(ranks, active)
    covered = np.zeros(n, np.int64)
    longest = np.zeros(len(docs), np.int64)
    if len(suffixes):  # in suffix order, of those with a repeated 8-word window
        suffixes = suffixes[np.argsort(ranks[suffixes], kind="stable")]
        left, right = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(len(left), np.int64)
        for stride, level in reversed(levels):
            same = level[np.minimum(left, n - 1)] == level[np.minimum(right, n - 1)]
            same &= (left < n) & (right < n)
            step = stride * same
            common += step
            left += step
            right += step
        reach = np.maximum(np.append(common, 0), np.concatenate([[0], common]))
        np.maximum.at(longest, doc[suffixes], reach)
        long = reach >= LEAST_REPEAT
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, suffixes[long], 1)
        np.add.at(marks, suffixes[long] + reach[long], -1)
        covered = (np.cumsum(marks)[:n] > 0).astype(np.int64)
    return np.add.reduceat(eight, starts[:-1]), np.add.reduceat(covered, starts[:-1]), longest


def _ranks(keys: np.ndarray, order: np.ndarray, ranks: np.ndarray, _: np.ndarray) -> np.ndarray:
    """Rank of a suffix: how many come before the first that equals it."""
    begins = np.concatenate([[True], keys[1:] != keys[:-1]])
    ranks[order] = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), 0))
    return ranks


def _tied(ranks: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of suffixes in order, those that share their rank with a neighbour."""
    own = ranks[order]
    same = own[1:] == own[:-1]
    return order[np.append(same, False) | np.concatenate([[False], same])]


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat"]
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def measure(texts: list[bytes]) -> list[np.ndarray]:
    """The columns of _NAMES for UTF-8 texts."""
    docs = [t.split() for t in texts]
    n_words = np.array([len(w) for w in docs], np.int64)
    word_chars = np.array([len(t.translate(None, _BLANKS).decode("utf-8", "surrogatepass")) for t in texts], np.int64)
    symbols = np.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in texts], np.int64)
    doubled = []
    for t in texts:
        lines = [line for line in t.split(b"\n") if line.strip(_BLANKS)]
        doubled.append(len(lines) - len(set(lines)))
    eight, covered, longest = repeats(docs)
    base = (n_words < 20) | (100 * eight > 30 * n_words)
    kept = ~base & (covered <= MOST_COVERED * n_words) & (longest <= LONGEST_REPEAT)
    return [n_words, word_chars, symbols, np.array(doubled, np.int64), eight, base, kept, covered, longest]


def with_quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: key and the columns of _NAMES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, text, 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(key), *map(pa.array, measure(arrow.octets(batch.column(text))))], [key, *_NAMES])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, {_SCHEMA}")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, text, 4 << 20):
            yield batch.filter(pa.array(measure(arrow.octets(batch.column(text)))[6]))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the columns that SQL can restate; with_quality() has those of the method too."""
    return with_quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("covered_words", "longest_repeat")


def _covered_sql(k: int) -> str:
    """Words in k-word windows that a document holds twice or more."""
    places = f"range(1, greatest(len(w) - {k - 2}, 1))"
    windows = f"SELECT d, unnest({places}) AS i, unnest(list_transform({places}, lambda i: hash(array_to_string(w[i:i + {k - 1}], ' ')))) AS h FROM w"
    twice = f"SELECT d, i, lead(i) OVER (PARTITION BY d ORDER BY i) AS following FROM (SELECT d, i, count(*) OVER (PARTITION BY d, h) AS n FROM ({windows})) WHERE n > 1"
    return f"c{k} AS (SELECT d, sum(least({k}, coalesce(following - i, {k}))) AS n FROM ({twice}) GROUP BY d)"


#: A repeat of over LONGEST_REPEAT words is a window of one word more that occurs twice.
_OVER = LONGEST_REPEAT + 1
ORACLE = rf"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
{_covered_sql(BASE_WINDOW)}, {_covered_sql(LEAST_REPEAT)}, {_covered_sql(_OVER)},
l AS (SELECT d, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
b AS (SELECT w.d, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(base.n, 0)::BIGINT AS n_repeat_words, coalesce(own.n, 0) AS covered, long.n IS NOT NULL AS long
  FROM w JOIN l USING (d) LEFT JOIN c{BASE_WINDOW} base USING (d) LEFT JOIN c{LEAST_REPEAT} own USING (d) LEFT JOIN c{_OVER} long USING (d)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND covered <= {MOST_COVERED}::DOUBLE * n_words AND NOT long AS kept FROM f
"""
