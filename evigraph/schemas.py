"""Schemas, enumerations and fixed word lists of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame

ARTICLE = "pmid string, title string, abstract string, document_type string, journal string, year int, authors string, mesh_terms string, doi string, keywords string, pmc_id string"
DOCUMENT = "id string, title string, text string, source string, pub_year int, extras map<string,string>"
EXTRACTED = "doc_id string, text string, start_pos int, end_pos int, source_model string, entity_type string, source_label string, sentence_id int, sentence_text string, ner_confidence double, linking_confidence double, umls_cui string, umls_preferred_name string, umls_semantic_types array<string>, chebi_id string, go_id string, mesh_id string, parent_classes array<string>, mention_seq long"
LINK = "text string, umls_cui string, linking_confidence double, umls_preferred_name string, umls_semantic_types array<string>"
ENTITY = "id string, name string, entity_type string, umls_cui string, chebi_id string, go_id string, mesh_id string, umls_preferred_name string"
MENTION = "doc_id string, entity_id string, text string, sentence_id int, sentence_text string, start_pos int, end_pos int, source_label string, mention_seq long"
PAIR = "entity_a_id string, entity_b_id string, sent_count long, docs_count long, doc_ids_sample array<string>, evidence_sentences array<string>"

# Annotation labels and the entity types they stand for.
LABEL_TYPES = {
    "CHEMICAL": "chemical", "SIMPLE_CHEMICAL": "chemical", "CHEBI": "chemical", "GENE_OR_GENE_PRODUCT": "gene", "GGP": "gene", "DISEASE": "disease", "CANCER": "disease",
    "ORGAN": "anatomy", "TISSUE": "anatomy", "ANATOMICAL_SYSTEM": "anatomy", "MULTI_TISSUE_STRUCTURE": "anatomy", "DEVELOPING_ANATOMICAL_STRUCTURE": "anatomy", "IMMATERIAL_ANATOMICAL_ENTITY": "anatomy",
    "ORGANISM_SUBDIVISION": "anatomy", "CELL": "cell_type", "CL": "cell_type", "CELLULAR_COMPONENT": "cellular_component", "GO": "biological_process", "ORGANISM": "organism", "TAXON": "organism",
    "SO": "sequence_feature", "AMINO_ACID": "amino_acid", "ORGANISM_SUBSTANCE": "substance", "PATHOLOGICAL_FORMATION": "pathology",
}
UNKNOWN_TYPE = "unknown"

# Names too general to say anything in a relationship.
STOPWORDS = frozenset((
    "patients", "patient", "women", "men", "subjects", "subject", "individuals", "individual", "participants", "participant", "study", "studies", "analysis", "results", "conclusion", "background",
    "method", "methods", "treatment", "therapy", "tissue", "tissues", "blood", "plasma", "cancer", "cancers", "tumor", "tumor cells", "cancer cells", "disease", "diseases", "human", "animal", "mouse",
    "genes", "protein", "proteins", "cells", "cell", "cell type", "cell types", "cell line", "cell lines", "cellular", "enzyme", "enzymes", "enzymatic", "organism", "organisms", "molecule", "compounds",
    "drug", "drugs", "lipid", "lipids", "fatty acids", "amino acids", "metabolite", "metabolites", "molecules", "molecular", "metabolism", "metabolics", "metabolisms", "inhibitor", "inhibitors",
    "activator", "activators", "pathway", "pathways", "levels", "expression", "expressions", "signaling", "regulation",
))


def assert_columns(df: DataFrame, schema: str) -> DataFrame:
    """``df`` if it has all columns of a schema constant; its own order and further columns stay."""
    missing = [c for c in (part.split()[0] for part in schema.split(", ")) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
