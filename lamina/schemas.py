"""Row types of the corpus."""

from __future__ import annotations

from pyspark.sql import types as T


def _row(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


ARTICLE_DDL = "pmid string, title string, abstract string, authors array<string>, journal string, pub_date string, language string, topic string, source string, url string"
DRUG_DDL = (
    "brand_name string, generic_name string, drug_class string, indications_and_usage string, dosage_and_administration string, contraindications string, "
    "warnings_and_cautions string, adverse_reactions string, drug_interactions string, mechanism_of_action string, topic string, source string"
)
GUIDELINE_DDL = "title string, topic string, clean_text string, raw_text string, num_pages int, num_tables int, num_images int, source_url string, source string"
TABLE_DDL = "topic string, page_number int, table_data array<array<string>>"
IMAGE_DDL = "topic string, page_number int, image_index int, filename string, width int, height int, image_type string"
METADATA_DDL = "struct<title:string,field:string,page_number:int,table_part:int,table_parts_total:int,token_split_part:int,token_split_parts_total:int>"
CHUNK_DDL = f"chunk_id string, point_id string, text string, raw_text string, source string, topics array<string>, source_id string, chunk_index int, chunk_type string, metadata {METADATA_DDL}"
TEXT_INDEX_DDL = "point_id string, chunk_id string, source string, topics array<string>, source_id string, chunk_type string"
IMAGE_INDEX_DDL = "filename string, topics array<string>, page_number int, image_type string"
FAILURE_DDL = "source string, topic string, key string, error string"

RAW_ARTICLE_DDL = (
    "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Language:array<string>,Abstract:struct<AbstractText:array<string>>,"
    "AuthorList:array<struct<LastName:string,ForeName:string,CollectiveName:string>>,Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,Month:string,Day:string>>>>>"
)
RAW_DRUG_DDL = (
    "openfda struct<brand_name:array<string>,generic_name:array<string>,pharm_class_epc:array<string>>, "
    + ", ".join(
        f"{f} array<string>"
        for f in ("indications_and_usage", "dosage_and_administration", "contraindications", "warnings_and_cautions", "adverse_reactions", "drug_interactions", "mechanism_of_action")
    )
)
#: Fields a record must have to be valid.
REQUIRED = {
    "article": ["pmid", "title", "abstract", "authors", "journal", "pub_date", "language", "topic", "url"],
    "drug": ["brand_name", "generic_name", "indications_and_usage", "topic"],
    "guideline": ["title", "topic", "clean_text", "raw_text", "num_pages", "num_tables", "num_images", "source_url"],
    "table": ["topic", "page_number", "table_data"],
    "image": ["topic", "page_number", "image_index", "filename", "width", "height"],
    "chunk": ["chunk_id", "point_id", "text", "raw_text", "source", "topics", "source_id", "chunk_index"],
}
