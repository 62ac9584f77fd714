"""Schemas of the engine's tables, as DDL; every ordered table carries its order as a column."""

WORDS = "doc_id long, page_no int, word_seq int, text string, x0 double, x1 double, top double, bottom double, upright boolean"
PAGES = "doc_id long, page_no int, width double, height double"
PAGE_IMAGES = "doc_id long, page_no int, image_path string"
LINES = "doc_id long, page_no int, line_no int, seg_no int, top double, bottom double, x0 double, x1 double, text string"
REGIONS = "doc_id long, page_no int, region_no int, text string, x0 double, top double, x1 double, bottom double, translatable boolean, translated_text string"
CHUNKS = "doc_id long, page_no int, chunk_no int, text string"
TEX_FILES = "project_id long, path string, content string"
TEX_SEGMENTS = "project_id long, path string, seg_no int, raw string, protected string, placeholders array<string>"
JOBS = "job_id string, status string, engine string, model string, percent int, message string, created_at double, started_at double, completed_at double, resource_reserved_mb long"
