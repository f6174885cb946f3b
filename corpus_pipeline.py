"""A corpus pipeline: five stages over the documents table, each written and read again before the next.

1. language_id: documents that language identification rejects go.
2. line_dedup: later occurrences of runs of three or more lines, or of one line of 50 words or more, leave the texts.
3. jaccard_join: of each group of near duplicates (five-word shingles, 0.8) the smallest id stays.
4. suffix_dedup: later occurrences of 100-byte strings leave the texts.
5. best_fit: what is left is packed into sequences of 512 to 4096 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.jaccard_join import near_duplicates
from graphloom.llm.language_id import recognised
from graphloom.llm.line_dedup import without_repeated_lines
from graphloom.llm.packing import packed
from graphloom.llm.store import documents, written
from graphloom.llm.suffix_dedup import without_repeats

#: (name, function): each takes (spark, docs, sf_dir) and returns what the next one gets.
STAGES = [
    ("language_id", recognised),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", without_repeats),
    ("best_fit", packed),
]

#: SQL can express neither the language model nor the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
