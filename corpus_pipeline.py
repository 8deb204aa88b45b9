"""The training-corpus pipeline over the documents table, stage by stage.

A stage decides on all that the one before it kept, and its decisions take effect; all but the last return the columns of
documents as they are, whatever further columns there are and whatever they are called.

Edges: a null, empty or letterless text has no language and goes with the first stage. Rows of null id go through all stages
like others, except that no near copy of them is looked for. Of rows that repeat id and text one stays; of rows of one id and
different texts each is a document of its own. A null source is a source of its own. Copies that the mixing makes are equal
rows and give equal records. An empty table gives the dictionary's row alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm.common import saved, table
from quillspan.llm.decontamination import drop_contaminated
from quillspan.llm.jaccard_join import keep_one_of_each_group
from quillspan.llm.language_id import keep_identified
from quillspan.llm.mixing import mix_sources
from quillspan.llm.token_binary import token_binary


def to_binary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: token-id records of what the others kept."""
    return token_binary(docs)


STAGES = [
    ("language_id", keep_identified),
    ("jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_binary", to_binary),
]

#: Language models, Newton iterations and compressed records are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from documents on, each one's rows written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
