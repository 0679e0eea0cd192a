"""The envelope that every point-in-time record has, and the registry of modalities."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that a write must bring; the others have defaults.
REQUIRED = ["entity_id", "modality", "effective_date", "availability_date", "restated_at", "source", "source_ref"]

ENVELOPE = T.StructType(
    [
        T.StructField("entity_id", T.StringType(), False),
        T.StructField("modality", T.StringType(), False),
        T.StructField("effective_date", T.DateType(), False),
        T.StructField("availability_date", T.DateType(), False),
        T.StructField("restated_at", T.DateType()),
        T.StructField("source", T.StringType(), False),
        T.StructField("source_ref", T.StringType(), False),
        T.StructField("recorded_at", T.TimestampType(), False),
        T.StructField("belief", T.DoubleType(), False),
        T.StructField("perspective", T.StringType(), False),
        T.StructField("policy_tags", T.ArrayType(T.StringType()), False),
        T.StructField("source_certainty", T.DoubleType(), False),
        T.StructField("valid_from_uncertainty_days", T.IntegerType(), False),
    ]
)


@dataclass(frozen=True)
class Modality:
    """A canonical table: what it holds beyond the envelope, what identifies a fact within (entity, effective date), and defaults."""

    name: str
    payload: str
    keys: tuple[str, ...]
    perspective: str
    certainty: float = 1.0
    tags: tuple[str, ...] = field(default=())

    @property
    def schema(self) -> T.StructType:
        return T.StructType(ENVELOPE.fields + T.StructType.fromDDL(self.payload).fields)


MODALITIES: dict[str, Modality] = {}


def register_modality(modality: Modality) -> None:
    """Add or replace a modality; its keys then drive every point-in-time operator."""
    MODALITIES[modality.name] = modality


for _m in (
    Modality("financials", "concept string, taxonomy string, period_start date, period_end date, fiscal_year int, fiscal_period string, unit string, value double, form string, accession string, context_id string, dimensions_json string", ("concept", "taxonomy", "fiscal_year", "fiscal_period", "unit", "context_id", "dimensions_json"), "sec_edgar:xbrl_instance"),
    Modality("filings_text", "form string, accession string, item_id string, item_title string, chunk_idx int, n_chunks_in_item int, text string, n_chars int, n_tokens_approx int", ("form", "item_id", "chunk_idx"), "sec_edgar:filing_html"),
    Modality("earnings_calls", "coverage_class string, form string, accession string, item_id string, chunk_idx int, text string, n_chars int, n_tokens_approx int", ("accession", "chunk_idx"), "derived:filings_text/8-K_item_2.02"),
    Modality("market", "frequency string, open double, high double, low double, close double, adj_close double, volume double, dividend double, split_ratio double, ticker string", ("frequency",), "yahoo_finance", 0.95),
    Modality("macro", "series_id string, value double, series_title string, units string, frequency string", ("series_id",), "fred:alfred"),
    Modality("news", "global_event_id string, cameo_event_code string, event_root_code string, quad_class int, goldstein_scale double, tone double, source_url string, actor1_name string, actor2_name string, n_mentions int, avg_tone double", ("global_event_id",), "gdelt:events2", 0.6),
    Modality("insider_trades", "insider_cik string, insider_name string, is_director boolean, is_officer boolean, is_ten_percent_owner boolean, officer_title string, security_title string, is_derivative boolean, transaction_code string, shares double, price_per_share double, acquired_disposed string, post_transaction_shares double, direct_or_indirect string, exercise_price double, expiration_date date, transaction_index int, period_of_report date, form string, accession string", ("insider_cik", "security_title", "transaction_code", "is_derivative", "exercise_price", "transaction_index"), "sec_edgar:form4"),
    Modality("patents", "patent_number string, application_date date, grant_date date, assignee_name_as_filed string, title string, abstract string, claims_count int, cpc_classifications string, inventors string", ("patent_number",), "uspto:patentsview"),
    Modality("hiring", "naics_industry string, naics_label string, measure string, value double, seasonal_adjustment string", ("measure",), "bls:jolts"),
    Modality("supply_chain", "target_entity_id string, target_name_as_filed string, relationship_type string, weight_qualifier string, evidence_span string, evidence_hash string, extractor_model string, confidence double, form string, accession string, item_id string", ("target_entity_id", "relationship_type", "evidence_hash"), "sec_edgar:ie", 0.7),
):
    register_modality(_m)


def fact_key(modality: str, columns: list[str]) -> list[str]:
    """The columns that identify one logical fact, as far as the table has them."""
    return [c for c in ("entity_id", "effective_date", *MODALITIES[modality].keys) if c in columns]


def defaults(modality: str) -> dict[str, Column]:
    """The envelope columns that a write may leave out."""
    m = MODALITIES[modality]
    return {
        "recorded_at": F.current_timestamp(),
        "belief": F.lit(1.0),
        "perspective": F.lit(m.perspective),
        "policy_tags": F.array(*map(F.lit, m.tags)).cast("array<string>"),
        "source_certainty": F.lit(m.certainty),
        "valid_from_uncertainty_days": F.lit(0),
    }


def backfill(df: DataFrame, modality: str) -> DataFrame:
    """Add the envelope columns that are missing, with the modality's defaults; those present are left alone."""
    return df.withColumns({c: v for c, v in defaults(modality).items() if c not in df.columns})


def missing_columns(df: DataFrame, modality: str) -> list[str]:
    """What `backfill` would add: the dry run of a migration."""
    return [c for c in defaults(modality) if c not in df.columns]


def conform(df: DataFrame, modality: str) -> DataFrame:
    """Check the required columns, back-fill, and cast to the modality's schema; payload columns that are missing are null."""
    absent = [c for c in REQUIRED if c not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {', '.join(absent)}")
    full = backfill(df, modality)
    return full.select(*((F.col(f.name) if f.name in full.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in MODALITIES[modality].schema))
