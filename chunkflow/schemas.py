"""Schemas of the tables that pass between operators; nothing is inferred."""

PAGES = "doc_id string, page_no int, text string"
DOCUMENTS = "doc_id string, raw string"
CHUNKS = "doc_id string, chunk_index int, text string"
ATTEMPTS = "doc_id string, chunk_index int, attempt int, output string, error string"
RESULTS = "doc_id string, chunk_index int, status string, output string, error string, attempts int"
BLOCKS = "doc_id string, line_no int, kind string, text string"
MANIFEST_ITEM = "struct<status:int,attempts:int,lastError:string,updatedAt:timestamp>"
MANIFEST = f"struct<sourcePdfPath:string,targetLanguage:string,startedAt:timestamp,items:map<string,{MANIFEST_ITEM}>>"
RESPONSE = "struct<output:array<struct<type:string,content:array<struct<type:string,text:string>>>>>"
#: Codes of chunk states at rest.
STATUS_CODES = {"Pending": 0, "Success": 1, "Failed": 2, "Quarantined": 3}
