"""Declared schemas; sources never infer."""

from __future__ import annotations

# The fields of an article row, all strings, and their names in a delivery.
ARTICLE_FIELDS = (
    "cid", "id", "citation_id", "texte", "texteHtml", "etat", "dateDebut", "dateFin", "nature", "type", "sectionParentId", "sectionParentTitre", "fullSectionsTitre", "nota", "notaHtml", "ref",
)
ARTICLE = ", ".join(f"{f} string" for f in ARTICLE_FIELDS)
GOLDEN = (
    "id string, question string, history array<map<string,string>>, expected_state string, gold_fiches array<string>, gold_spans array<string>, gold_articles array<string>, "
    "expected_points array<string>, tags array<string>"
)
ITEM_SCORES = (
    "item_id string, short_circuit_path string, fiche_recall_at_4 double, fiche_recall_at_10 double, fiche_recall_at_candidate double, article_recall_at_4 double, article_recall_at_10 double, "
    "article_recall_at_candidate double, zero_articles boolean, floor_correct boolean, span_containment_at_4 double"
)
RUN = f"header struct<run_id:string, arm:string, rung:string, created_at:string, retrieval_config:map<string,string>>, items array<struct<{ITEM_SCORES.replace(' ', ':').replace(',:', ', ')}>>"
ANSWER_SCORES = (
    "item_id string, expected_state string, actual_state string, state_correct boolean, citation_valid boolean, fabricated_ids array<string>, citation_correctness double, faithfulness double, "
    "point_coverage double, judge_error string"
)
_FIELDS = "run_id:string, arm:string, rung:string, created_at:string, retrieval_config:map<string,string>"
ANSWER_RUN = f"header struct<{_FIELDS}>, items array<struct<{ANSWER_SCORES.replace(' ', ':').replace(',:', ', ')}>>"
ENVELOPE = "struct<type:string, explanation:string, fondement_juridique:array<struct<article_id:string, gloss:string>>, aucun_fondement:string, motif:string>"
CALIBRATION = (
    "golden_id string, archetype string, metric string, question string, expected_points array<string>, retrieved array<string>, context string, "
    f"clean struct<envelope:{ENVELOPE}, label:string>, faulted struct<envelope:{ENVELOPE}, label:string>"
)
POINT = "id string, dense array<float>, sparse_indices array<bigint>, sparse_values array<float>, payload string"
MANIFEST = "producer string, licence string, licence_url string, download_url string, filename string, file_date string, retrieved_at string, sha256 string, document_count bigint"
