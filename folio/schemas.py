"""Declared schemas of the engine's tables; nothing is inferred."""

LINES = "document_id string, document_name string, line_no long, page int, y0 double, font_size double, is_bold boolean, text string"
WORDS = "document_id string, page int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string"
TABLES = "document_id string, table_id string, table_no int, page int, y0 double, headers array<string>, rows array<array<string>>"
BLOCKS = "document_id string, block_no long, block_type string, text string, page int, y0 double, depth int, section_number string, title string, referenced_sections array<string>, table_id string"
QUESTIONS = "document_name string, questions array<struct<id: string, category: string, question: string, expected_keyword_groups: array<array<string>>, is_answerable: boolean, expected_answer: string, notes: string>>"
CHUNKS = "chunk_id string, document_id string, document_name string, chunk_no long, chunk_type string, node_id string, section_number string, section_title string, parent_section string, page_start int, page_end int, source_text string, display_text string, token_count int, referenced_sections array<string>, table_id string"
