"""Table schemas, as DDL strings."""

ITEMS = (
    "entity string, kind string, description string, popularity long, ner_types array<string>, ner_type string, "
    "labels map<string,string>, aliases map<string,array<string>>, explicit_types array<string>, extended_types array<string>, urls map<string,string>"
)
EDGES = "subject string, predicate string, object string, pos int"
LITERALS = "subject string, predicate string, datatype string, value string, pos int"
TYPE_EDGES = "child string, parent string, property string"
CLOSURE = "subclass string, superclass string, min_depth int"
_TEXT = "struct<language:string,value:string>"
DUMP = (
    f"id string, type string, labels map<string,{_TEXT}>, aliases map<string,array<{_TEXT}>>, descriptions map<string,{_TEXT}>, "
    "sitelinks map<string,struct<site:string,title:string>>, "
    "claims map<string,array<struct<mainsnak:struct<property:string,datatype:string,datavalue:struct<value:string>>>>>"
)
COMPANY_EXTRA = "permalink string, cb_url string, description string, rank double"
