"""Schemas of the tables and files that the engine reads and writes."""

from pyspark.sql.types import StructType

MANIFEST = "url string, source string, domain string, title string, page_count int, estimated_steps int, length_bucket string, language string, has_steps boolean, has_safety_clauses boolean, license string, redistribute_ok string, bytes long, sha256 string"
BLOCK = "page int, bbox array<double>, text string, font_size double, is_heading boolean"
STEPS = "array<struct<id:string,ordinal:int,text:string,page:int>>"
PRECONDITIONS = "array<struct<id:string,text:string>>"
CONSTRAINTS = "array<struct<id:string,text:string,kind:string>>"
EDGES = "array<struct<type:string,`from`:string,`to`:string>>"
GRAPH = f"struct<steps:{STEPS},preconditions:{PRECONDITIONS},constraints:{CONSTRAINTS},edges:{EDGES}>"
CHUNK_GRAPHS = f"doc_sha string, chunker string, graphs array<struct<chunk_idx:int,graph:{GRAPH},error:string,input_tokens:int,output_tokens:int,cached_tokens:int>>"
MERGED = (
    "steps array<struct<id:string,ordinal:int,text:string,page:int,_chunk:int>>, preconditions array<struct<id:string,text:string,_chunk:int>>, "
    f"constraints array<struct<id:string,text:string,kind:string,_chunk:int>>, edges {EDGES}, _duplicate_count int, _dropped_edge_count int"
)
ORACLE = f"doc_sha string, doc_title string, truncated_input boolean, graph {GRAPH}, error string, model string, elapsed_s double, in_tokens int, out_tokens int"


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
