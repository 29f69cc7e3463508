"""Schemas of articles, tables, labelled tables and table pairs."""

from __future__ import annotations

LINK = "struct<structured:string,anchor:string>"
VALUE_COUNT = "struct<value:string,count:int>"
COLUMN = f"struct<name:string,col_span:int,row_span:int,value_dist:array<{VALUE_COUNT}>>"
HEADER = f"struct<level:int,columns:array<{COLUMN}>>"
CELL = f"struct<column:string,col_index:int,value:string,structured_values:array<{LINK}>>"
ROW = f"struct<row_index:int,`values`:array<{CELL}>>"
TABLE = f"struct<caption:string,markup:string,id:int,header:array<{HEADER}>,rows:array<{ROW}>>"
ARTICLE = f"struct<entity:string,sections:array<struct<section:string,tables:array<{TABLE}>>>>"

#: The same table without what a reader may leave unread.
TABLE_WITHOUT_COUNTS = TABLE.replace(f",value_dist:array<{VALUE_COUNT}>", "")
TABLE_HEADERS_ONLY = f"struct<caption:string,id:int,header:array<{HEADER}>>"
TABLE_NAMES_ONLY = TABLE_HEADERS_ONLY.replace(f",value_dist:array<{VALUE_COUNT}>", "")
TABLE_CELLS = f"struct<caption:string,id:int,header:array<{HEADER}>,rows:array<struct<row_index:int,`values`:array<struct<column:string,value:string>>>>>"

#: What the extractor emits: the nested table, and identities of header and cell objects that cover several slots.
X_COLUMN = f"struct<header_uid:int,col_index:int,name:string,col_span:int,row_span:int,value_dist:array<{VALUE_COUNT}>>"
X_HEADER = f"struct<level:int,columns:array<{X_COLUMN}>>"
X_CELL = f"struct<cell_uid:int,is_first:boolean,header_uid:int,column:string,column_at_index:string,col_index:int,value:string,structured_values:array<{LINK}>>"
X_ROW = f"struct<row_index:int,`values`:array<{X_CELL}>>"
X_TABLE = f"struct<table_ord:int,sub_id:int,caption:string,markup:string,num_columns:int,header:array<{X_HEADER}>,rows:array<{X_ROW}>>"
X_SECTION = f"struct<section_ord:int,section:string,tables:array<{X_TABLE}>>"
X_ERROR = "struct<section_ord:int,section:string,table_ord:int,reason:string,html:string>"
EXTRACTED = f"entity string, sections array<{X_SECTION}>, errors array<{X_ERROR}>"

LABELLED_TABLE = "entity string, section string, table_id int, label string, label_confidence double, table_html string, table_json string, table_markup string"
TABLE_PAIR = "source_article string, matching_article string, source_section string, matching_section string, source_table_id int, matching_table_id int, label string"
