"""Evidence about a pair: a feature vector that never invents a value, separate signals, and the object that a claim carries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.provenance import content_hash

# Features in order, with the note of those that have no instrument.
_MODEL, _SPANS = "needs GPU/embedding model", "needs error-span detector"
FEATURES = {
    "q_xCOMET": _MODEL, "q_MetricX": _MODEL, "q_SaQE": _MODEL, "N_major": _SPANS, "N_critical": _SPANS, "A_alignment": _MODEL, "M_morph": _MODEL, "R_retrieval": _MODEL,
    "D_ensemble": None, "C_crosslingual": "no parallels", "B_backtranslation": _MODEL,
}
# Signals and fields of evidence that have no instrument, with their notes; where evidence comes from.
NO_SIGNAL = {"source_semantic_coverage": "needs alignment kernel", "morphological_accounting": "needs ByT5/Vidyut", "critical_errors_detected": "needs error-span detector"}
NO_FIELD = {
    "segmentation": "needs ByT5-Sanskrit/Vidyut (GPU or import)", "morphology": "needs ByT5/Vidyut/dcs-sh (import available)", "syntax": "needs dependency parse (ByT5-Sanskrit)",
    "alignment": "needs an alignment kernel", "lexical_evidence": "needs the lemma->sense map", "intertextual_evidence": "needs the DCS intertextual index",
    "evaluator_evidence": "needs xCOMET/SaQE (GPU)", "terminology": "needs the glossary + lemma map", "uncertainty": "needs the calibrated + conformal layer (GPU)",
}
METHOD, VERSION, KEPT = "evidence_object", "0.1.0", 5


def _feature(value: Column, note: str | None, verdict: Column | None = None, n: Column | None = None) -> Column:
    value, none = value.cast("double"), F.lit(None)
    return F.struct(
        value.alias("value"), F.when(value.isNull(), "unavailable").otherwise("available").alias("status"), F.when(value.isNull(), F.lit(note)).alias("note"),
        (none if verdict is None else verdict).cast("string").alias("verdict"), (none if n is None else n).cast("long").alias("n_parallels"),
    )


def feature_vector(disagreement: Column, verdict: Column, crosslingual: Column, n_parallels: Column) -> Column:
    """MAP feature -> struct(value, status, note, verdict, n_parallels): the disagreement of candidates with its verdict, and the mean
    agreement of the candidate with the texts of its parallels (parallels.crosslingual) with their number; all others need a model."""
    have = {"D_ensemble": _feature(disagreement, None, verdict), "C_crosslingual": _feature(crosslingual, FEATURES["C_crosslingual"], n=F.nullif(n_parallels, F.lit(0)))}
    return F.create_map(*[x for name, note in FEATURES.items() for x in (F.lit(name), have.get(name, _feature(F.lit(None), note)))])


def proof_score(gate: Column, gold: Column, chrf: Column, z: Column) -> Column:
    """Separate signals, never one number: gate, what has no instrument, the agreement of candidates out of z, chrF against gold (null without gold), decision."""
    none = {name: F.struct(F.lit(None).cast("double").alias("value"), F.lit("unavailable").alias("status"), F.lit(note).alias("note")).alias(name) for name, note in NO_SIGNAL.items()}
    there = F.coalesce(gold, F.lit("")) != ""
    return F.struct(
        gate.alias("deterministic_gate"), none["source_semantic_coverage"], none["morphological_accounting"], z["D_ensemble"].alias("candidate_agreement"), none["critical_errors_detected"],
        gate.alias("proof_gate"), F.when(there, F.round(chrf, 3)).alias("gold_chrF"), F.when(gate == "PASS", "accepted").otherwise("review").alias("decision"),
    )


def evidence_object(source: Column, candidate: Column, gate: Column, blocking: Column, parallels: Column, candidates: Column, run_signature: Column | None = None) -> Column:
    """The object that a claim carries: texts with their hashes, the gate, what each instrument found, or that there is none, where it
    comes from, and the hash of all that. At most KEPT parallels and candidates are kept, and all are counted. Keeps the contract PROOF_EVIDENCE."""
    hashed = lambda x: F.struct(x.alias("text"), F.sha2(x, 256).alias("hash"))
    listed = lambda xs, name: F.struct(F.coalesce(F.size(xs), F.lit(0)).cast("long").alias(f"n_{name}"), F.slice(F.coalesce(xs, F.array()), 1, KEPT).alias(name))
    none = {name: F.struct(F.lit("unavailable").alias("status"), F.lit(note).alias("note")) for name, note in NO_FIELD.items()}
    signature = F.lit("") if run_signature is None else F.coalesce(run_signature, F.lit(""))
    fields = {
        "source": hashed(source), "candidate": hashed(candidate), "deterministic_gate": gate, "blocking": blocking,
        **{k: none[k] for k in ("segmentation", "morphology", "syntax", "alignment", "lexical_evidence")}, "parallel_evidence": listed(parallels, "parallels"), "intertextual_evidence": none["intertextual_evidence"],
        "candidate_distribution": listed(candidates, "candidates"), **{k: none[k] for k in ("evaluator_evidence", "terminology", "uncertainty")},
        "provenance": F.struct(signature.alias("run_signature"), F.lit(METHOD).alias("method"), F.lit(VERSION).alias("schema_version")), "decision": F.when(gate == "PASS", "accepted").otherwise("review"),
    }
    body = [c.alias(k) for k, c in fields.items()]
    return F.struct(*body, content_hash(F.to_json(F.struct(*body))).alias("artifact_hash"))
