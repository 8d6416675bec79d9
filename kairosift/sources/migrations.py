"""Schema revisions of the engine's tables, in one line from nothing to the newest, each with its way back.

A revision adds tables (with seeded rows) and columns (null in the rows that are there). Going up never touches what rows hold; going down
drops what the revision added and nothing else. Tables are a dictionary of DataFrames, such as a snapshot's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Revision:
    name: str
    tables: dict[str, str] = field(default_factory=dict)  # name: columns
    columns: dict[str, dict[str, str]] = field(default_factory=dict)  # table: {column: type}
    seeds: dict[str, list[tuple]] = field(default_factory=dict)


REVISIONS = [
    Revision(
        "lifecycle",
        {
            "corpora": "corpus_id string, name string", "documents": "document_id string, corpus_id string, title string",
            "versions": "version_id string, document_id string, corpus_id string, version_no int, status string, source_hash string, artifact_key string, media_type string, byte_size bigint, published_pg string",
            "generations": "generation_id string, kind string, config string", "pointer": "id int, pg string, srg string",
        },
        seeds={"generations": [("pg1", "PROCESSING", "{}"), ("srg1", "SEARCH_REPRESENTATION", "{}")], "pointer": [(1, "pg1", "srg1")]},
    ),
    Revision("runs and jobs", {"runs": "run_id string, version_id string, attempt int, stage string, error_code string, finished_at timestamp", "jobs": "version_id string, state string, attempts int, retry_after timestamp, heartbeat_at timestamp"}),
    Revision("normalized artifacts", columns={"runs": {"normalized_artifact_key": "string"}}),
    Revision("chunks", {"chunks": "chunk_id string, version_id string, document_id string, corpus_id string, pg string, ordinal int, source_text string, contextualized_text string, content_hash string, token_count int"}),
    Revision("mentions", {"mentions": "mention_id string, chunk_id string, block_id string, start_offset int, end_offset int, text string, precision string, certainty string, origin string, start_year int, start_month int, start_day int, end_year int, end_month int, end_day int"}),
    Revision("representations", {"representations": "chunk_id string, srg string, v array<float>, model string, input_tokens int"}),
    Revision("active versions", columns={"documents": {"active_version_id": "string"}}),
]


class RevisionError(ValueError):
    """The tables aren't at the revision that they are said to be at."""


def upgrade(spark: SparkSession, tables: dict[str, DataFrame], at: int, to: int = len(REVISIONS)) -> dict[str, DataFrame]:
    """The ``tables`` of revision ``at`` (0: none) at revision ``to``."""
    out = dict(tables)
    for revision in REVISIONS[at:to]:
        for name, columns in revision.tables.items():
            if name in out:
                raise RevisionError(f"{revision.name}: {name} is there already")
            out[name] = spark.createDataFrame(revision.seeds.get(name, []), columns)
        for name, columns in revision.columns.items():
            if name not in out or set(columns) & set(out[name].columns):
                raise RevisionError(f"{revision.name}: {name} has no room for {', '.join(columns)}")
            out[name] = out[name].withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items()})
    return out


def downgrade(tables: dict[str, DataFrame], at: int, to: int) -> dict[str, DataFrame]:
    """The ``tables`` of revision ``at`` at the earlier revision ``to``."""
    out = dict(tables)
    for revision in REVISIONS[to:at][::-1]:
        for name, columns in revision.columns.items():
            out[name] = out[name].drop(*columns)
        for name in revision.tables:
            if out.pop(name, None) is None:
                raise RevisionError(f"{revision.name}: {name} isn't there")
    return out
