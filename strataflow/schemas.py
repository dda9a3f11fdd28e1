"""Explicit schemas of the tables, as DDL (no session is needed to import them)."""

BLOCK = "doc_id string, ord int, type string, text string, level int, page int, section string"
CHUNK = "doc_id string, chunk_id string, text string, kind string, section string, page int, lang string, file_name string, source_key string, author_hint string, venue string, year int, doc_type string"
DOCUMENT_META = (
    "doc_id string, file_name string, source_key string, file_hash string, file_metadata_author string, file_metadata_title string, author_hint string, created string, pages int, chunks int, tables int, "
    "ocr_pages int, ocr_skipped_pages int, ocr_low_yield_pages int, image_only_slides int, noise_blocks_dropped int, text_chars int, text_chars_per_page double, avg_chunk_chars double, low_yield boolean, "
    "category string, venue string, year int, doc_type string, status string, error string, processing_seconds double"
)
NUMERIC = "struct<parameter:string,operator:string,value:double,value_min:double,value_max:double,unit:string>"
ENTITY = "struct<tmp_id:string,type:string,name:string,name_norm:string,aliases:array<string>,geography:string,confidence:double>"
RELATION = f"struct<source:string,target:string,type:string,numeric:{NUMERIC},attrs:map<string,string>,confidence:double>"
EXTRACTION = (
    f"chunk_id string, doc_id string, source_doc string, source_chunk string, year int, result struct<entities:array<{ENTITY}>,relations:array<{RELATION}>>, "
    "model string, retries int, prompt_tokens int, completion_tokens int, cost_usd double, usage struct<prompt_tokens:int,completion_tokens:int>"
)
MANIFEST = "file_hash string, source_key string, etag string, status string, doc_id string, processed_at timestamp"

ENTITY_LABELS = ("Material", "Process", "Equipment", "Property", "Experiment", "Expert", "Organization", "Facility")
NODE_LABELS = (*ENTITY_LABELS, "Publication", "Chunk")
RELATION_TYPES = ("uses_material", "operates_at_condition", "produces_output", "described_in", "validated_by", "contradicts", "authored_by", "affiliated_with", "owns", "operates", "conducted_at", "uses_equipment", "part_of", "relates_to", "has_property")
NUMERIC_RELATIONS = ("has_property", "operates_at_condition")
DONE_STATUS = ("ok", "skipped_too_large", "scan_low_value")
