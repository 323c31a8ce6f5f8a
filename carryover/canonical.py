"""The canonical record: its type, its closed vocabularies, and checks as one pass over the rows."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from carryover.functions.canonical_json import canonical_text
from carryover.functions.identity import canonical_id, content_hash

# The fields of a record and their types, in order.
DDL = (
    "canonical_id string, source struct<system:string,adapter_version:string,export_version:string,satellite_id:string>, source_record_id string, source_locator string, "
    "scope string, content string, content_hash string, dna_class string, "
    "provenance struct<actor:string,actor_kind:string,method:string,source_ref:string,evidence:array<struct<source_ref:string,weight:double>>>, evidence_level string, scope_qualifier string, "
    "owner_declared string, source_kind string, source_extra string, tags array<string>, entities array<struct<id:string,kind:string,label:string>>, relations array<struct<kind:string,source:string,target:string>>, "
    "created_at string, updated_at string, observed_at string, valid_from string, valid_to string, expires_at string, ttl string, "
    "consent struct<exportable:boolean,retention:string,redact:array<string>,memory_enabled:boolean>, approval struct<state:string,receipt_ref:string>, "
    "sensitive_findings array<struct<rule_id:string,field_path:string,start:bigint,end:bigint,disposition:string,key_hash:string>>, deletion_intent string, "
    "tombstone struct<deleted_at:string,source_ref:string,actor:string>, embedding struct<model:string,dim:bigint,vector:array<double>,normalized:boolean>, "
    "reembed_plan struct<canonical_ids:array<string>,model:string,dim:bigint,quality_impact:string>, conflict_cluster_id string, "
    "conflict_candidates array<struct<canonical_id:string,basis:string,content_hash:string,record_hash:string>>, verdict struct<kind:string,cluster_id:string>"
)

# The closed vocabularies and the fields a record must have.
SCOPES = ["user", "project", "agent", "session", "tenant", "wing", "room"]
DNA_CLASSES = ["dna", "standard"]
EVIDENCE_LEVELS = ["measured", "official", "third_party", "inferred"]
ACTOR_KINDS = ["user", "agent", "model", "import", "scan"]
REQUIRED = ["canonical_id", "source", "source_record_id", "source_locator", "scope", "content", "content_hash", "dna_class", "provenance", "evidence_level"]


@lru_cache(maxsize=1)
def record_type() -> StructType:
    return StructType.fromDDL(DDL)


def fields() -> list[str]:
    """Pointers of all fields of a record."""
    return [f"/{name}" for name in record_type().names]


def completed(df: DataFrame) -> DataFrame:
    """``df`` with the fields of the type that it lacks, as nulls, in the order of the type."""
    has = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in has else F.lit(None).cast(f.dataType).alias(f.name)) for f in record_type().fields))


def _outside(column: Column, allowed: list[str]) -> Column:
    return column.isNotNull() & ~column.isin(allowed)


def problems(df: DataFrame) -> DataFrame:
    """(canonical_id, problem) of each rule a record breaks; values are never repeated in it.

    Checks required fields, vocabularies, the shape of ids and hashes, that the body's
    hash and the identity follow from the record, and that a vector has its length.
    """
    has = set(df.columns)
    rules: dict[str, Column] = {f"missing:/{f}": F.col(f).isNull() for f in REQUIRED}
    rules |= {
        "vocabulary:/scope": _outside(F.col("scope"), SCOPES),
        "vocabulary:/dna_class": _outside(F.col("dna_class"), DNA_CLASSES),
        "vocabulary:/evidence_level": _outside(F.col("evidence_level"), EVIDENCE_LEVELS),
        "vocabulary:/provenance/actor_kind": _outside(F.col("provenance.actor_kind"), ACTOR_KINDS),
        "shape:/canonical_id": ~F.col("canonical_id").rlike(r"\A[a-z2-7]{32}\z"),
        "shape:/content_hash": ~F.col("content_hash").rlike(r"\Asha256:[0-9a-f]{64}\z"),
        "derived:/content_hash": F.col("content_hash") != content_hash(F.col("content")),
        "derived:/canonical_id": F.col("canonical_id") != canonical_id(F.col("source.system"), F.col("source.satellite_id"), F.col("source_record_id")),
    }
    if "embedding" in has:
        rules["derived:/embedding/dim"] = F.col("embedding.dim") != F.size("embedding.vector")
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return df.select("canonical_id", F.explode(found).alias("problem"))


def record_json(df: DataFrame) -> Column:
    """The record as JSON text, without what the gate finds in it; absent fields are left out."""
    has = set(df.columns)
    return F.to_json(F.struct(*(c for c in record_type().names if c in has and c != "sensitive_findings")))


def with_record_hash(df: DataFrame) -> DataFrame:
    """``df`` with record_hash: the digest of the whole record in canonical JSON, null where it can't be written so."""
    return df.withColumn("record_hash", F.concat(F.lit("sha256:"), F.sha2(canonical_text(record_json(df)), 256)))
