"""Public jobs, one function per task."""

from labelspark.operators.audit import (
    export_frame as export_audit,
    integrity_gate,
    manual_records as record_manual,
    override_records as record_overrides,
    verify_chains as verify_audit,
)
from labelspark.operators.batch import (
    needs_attention as list_flagged,
    summarize,
    verify_batch as batch_verify,
)
from labelspark.operators.matching import verify_table as verify_labels
from labelspark.operators.retrieval import explain_flags, regulatory_lookup
from labelspark.operators.verification import (
    reverify_texts as verify_texts,
    validate_class_types,
    verify_warnings,
)
from labelspark.operators.words import reconstruct_text

__all__ = [
    "batch_verify", "explain_flags", "export_audit", "integrity_gate", "list_flagged",
    "reconstruct_text", "record_manual", "record_overrides", "regulatory_lookup", "summarize",
    "validate_class_types", "verify_audit", "verify_labels", "verify_texts", "verify_warnings",
]
