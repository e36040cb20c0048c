"""Schemas of the tables that the audit reads and makes."""

RECORD = (
    "title string, authors array<string>, year int, venue string, venue_aliases array<string>, issns array<string>, "
    "volume string, issue string, page string, article_number string, doi string, source string, source_id string, "
    "is_preprint boolean, aliases_resolved boolean"
)
REFERENCE = "ref_id long, line_no int, input_text string"
WORK_JSON = (
    "struct<DOI:string,title:array<string>,author:array<struct<family:string,name:string>>,type:string,"
    "issued:struct<`date-parts`:array<array<int>>>,`published-print`:struct<`date-parts`:array<array<int>>>,"
    "`published-online`:struct<`date-parts`:array<array<int>>>,`container-title`:array<string>,ISSN:array<string>,"
    "volume:string,issue:string,page:string>"
)
NOTICE_JSON = "struct<DOI:string,`update-to`:array<struct<DOI:string,type:string,source:string,label:string,updated:struct<`date-time`:string>>>>"
