"""The corpus and project tables as schemas, their allowed values, and loading by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS: dict[str, str] = {
    "workflow": "id BIGINT, name STRING, current_stage STRING, status STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "stage": "id BIGINT, workflow_id BIGINT, stage_name STRING, status STRING, started_at TIMESTAMP, ended_at TIMESTAMP",
    "execution_attempt": "id BIGINT, stage_id BIGINT, attempt_number INT, status STRING, started_at TIMESTAMP, ended_at TIMESTAMP, error_message STRING",
    "paper": "id BIGINT, workflow_id BIGINT, title STRING, source STRING, file_path STRING, pdf_url STRING, abstract STRING, pdf_candidates ARRAY<STRUCT<source:STRING,url:STRING,priority:INT>>, pdf_status STRING, doi STRING, status STRING, raw_text STRING, year INT, created_at TIMESTAMP, updated_at TIMESTAMP, application_score DOUBLE",
    "paper_content": "id BIGINT, paper_id BIGINT, section_name STRING, content STRING, latex_text STRING",
    "paper_figure": "id BIGINT, paper_id BIGINT, figure_id STRING, image_path STRING, caption STRING, section_hint STRING, page_number INT",
    "paper_table": "id BIGINT, paper_id BIGINT, table_id STRING, table_type STRING, headers ARRAY<STRING>, rows ARRAY<ARRAY<STRING>>, caption STRING, section_hint STRING, page_number INT",
    "paper_equation": "id BIGINT, paper_id BIGINT, equation_id STRING, raw_text STRING, normalized_latex STRING, context_before STRING, context_after STRING, section_source STRING, page_number INT, position_index INT",
    "research_knowledge": "id BIGINT, paper_id BIGINT, category STRING, value STRING, section_source STRING, sentence STRING, source_type STRING, confidence STRING, equation_id BIGINT",
    "research_relation": "id BIGINT, paper_id BIGINT, subject STRING, relation STRING, object STRING",
    "research_finding": "id BIGINT, paper_id BIGINT, workflow_id BIGINT, material STRING, synthesis_method STRING, characterization STRING, property_name STRING, property_value STRING, condition_text STRING, finding_text STRING, section_source STRING, confidence STRING, source_type STRING",
    "checkpoint": "paper_id BIGINT, workflow_id BIGINT, status STRING, findings_count INT",
    "project_event": "id BIGINT, project_id BIGINT, agent STRING, event_type STRING, summary STRING, payload STRING, started_at TIMESTAMP, ended_at TIMESTAMP, status STRING",
    "workload": "id BIGINT, project_id BIGINT, agent STRING, workload_type STRING, config STRING, status STRING, priority INT, created_at TIMESTAMP, started_at TIMESTAMP, completed_at TIMESTAMP",
    "global_paper": "id BIGINT, doi STRING, title STRING, abstract STRING, first_seen_project_id BIGINT, vector_indexed BOOLEAN, created_at TIMESTAMP",
    "global_paper_reference": "global_paper_id BIGINT, project_id BIGINT, workflow_id BIGINT",
    "instrument_result": "id BIGINT, project_id BIGINT, file_path STRING, technique STRING, confidence DOUBLE, signals ARRAY<STRING>, axis ARRAY<DOUBLE>, intensity ARRAY<DOUBLE>, match_score DOUBLE, gaps ARRAY<STRING>",
    "dft_result": "id BIGINT, project_id BIGINT, job_id STRING, calc_type STRING, output STRING, status STRING, wall_time_seconds DOUBLE, created_at TIMESTAMP",
    "document_section": "section_id STRING, document_id BIGINT, title STRING, status STRING, depends_on ARRAY<STRING>, position INT",
    "section_draft": "section_id STRING, version INT, draft STRING, score DOUBLE",
}

#: Rules that a row must meet: table -> name -> SQL condition that holds for good rows (null counts as failed only where said).
STAGES = ("S1", "S2", "S2_5", "S2_75", "S3", "S4", "S5", "S5_5")
RULES: dict[str, dict[str, str]] = {
    "workflow": {"current_stage": f"current_stage IS NULL OR current_stage IN {STAGES}", "status": "status IN ('created', 'running', 'paused', 'completed', 'failed')"},
    "stage": {"stage_name": f"stage_name IN {STAGES}"},
    "execution_attempt": {"attempt_number": "attempt_number > 0"},
    "paper": {"status": "status IN ('metadata', 'found', 'queued', 'downloading', 'downloaded', 'extracted', 'processed', 'skipped', 'failed')"},
}
#: Child table -> (its key, parent table, the parent's key).
PARENTS = {"stage": ("workflow_id", "workflow", "id"), "execution_attempt": ("stage_id", "stage", "id"), "paper": ("workflow_id", "workflow", "id"), "paper_content": ("paper_id", "paper", "id")}


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def violations(rows: DataFrame, table: str, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows that break a rule of their table, with the names of the rules in `violated`.

    Rules are columns, so all of a row's faults are told at once and one pass finds them; a parent's existence is an outer join.
    """
    faults = [F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in RULES.get(table, {}).items()]
    drop = []
    if parents and table in PARENTS and PARENTS[table][1] in parents:
        key, parent, parent_key = PARENTS[table]
        known = parents[parent].select(F.col(parent_key).alias("_parent")).distinct()
        rows = rows.join(known, F.col(key) == F.col("_parent"), "left")
        faults.append(F.when(F.col("_parent").isNull(), F.lit(f"unknown {parent}")))
        drop = ["_parent"]
    return rows.withColumn("violated", F.array_compact(F.array(*faults))).where(F.size("violated") > 0).drop(*drop)
