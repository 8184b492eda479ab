"""Schemas of the records that stages hand to each other."""

from __future__ import annotations

HEADING = "struct<level:int,text:string,id:string>"
LINK = "struct<url:string,text:string,rel:string>"
TABLE = "struct<caption:string,headers:array<string>,rows:array<array<string>>>"
TABLE_MD = "struct<caption:string,headers:array<string>,row_count:int,markdown:string>"
IMAGE = "struct<url:string,alt:string,title:string,width:string,height:string,loading:string,caption:string,nearest_heading:string,context_text:string,src_original:string>"
PDF = "struct<url:string,link_text:string,nearest_heading:string,context_text:string>"

#: How a page's image or PDF was downloaded.
DOWNLOAD = "struct<success:boolean,skipped:boolean,skip_reason:string,error:string,file_path:string,content_hash:string,file_size_bytes:long,width:int,height:int,image_type:string,pdf_page_count:int>"
IMAGE_RECORD, PDF_RECORD = (x[:-1] + f",download:{DOWNLOAD}>" for x in (IMAGE, PDF))

#: What the one HTML UDF returns for a page; Markdown clean-up, paths and tables follow as built-in expressions.
PARSED = (
    "struct<title:string,meta_description:string,meta_keywords:string,og_title:string,og_description:string,og_image:string,"
    f"canonical_url:string,language:string,page_type:string,raw_html_length:int,headings:array<{HEADING}>,images:array<{IMAGE}>,"
    f"pdfs:array<{PDF}>,links:array<{LINK}>,tables:array<{TABLE}>,schema_org:array<string>,markdown:string,warnings:array<string>>"
)
RESPONSE = "url string, final_url string, status_code int, content_type string, body binary, redirect_chain array<string>, response_time_ms int, error string, content_length long"
FRONTIER = "seq struct<depth:int,by:long,pos:int>, url string, norm string, host string, depth int, parent_url string, anchor_text string, url_hash string"
CHUNK = "text string, url string, title string, domain string, depth int, section string, chunk_index int, total_chunks int, source_type string, doc_id string"
PAGE = (
    "doc_id string, url string, final_url string, title string, domain string, depth int, parent_url string, crawled_at string, "
    f"status_code int, content_type string, response_time_ms int, language string, page_type string, meta_description string, "
    f"headings array<{HEADING}>, heading_hierarchy array<string>, body_text string, body_text_length int, tables array<{TABLE_MD}>, "
    f"internal_links array<{LINK}>, external_links array<{LINK}>, images array<{IMAGE_RECORD}>, pdfs array<{PDF_RECORD}>, schema_org array<string>, "
    "breadcrumbs array<string>, extraction_warnings array<string>, "
    "rag_status struct<chunked:boolean,embedded:boolean,indexed:boolean,chunk_count:int,error:string>"
)


def page_schema():
    """PAGE as a StructType; needs a session."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(PAGE)
