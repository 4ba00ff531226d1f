"""Declared schemas of every feed, payload and table (Spark DDL)."""

ARXIV_FEED = (
    "id string, submitter string, authors string, title string, categories string, "
    "abstract string, update_date string, authors_parsed array<array<string>>"
)
S2_FEED = (
    "paper_id string, title string, authors array<struct<first:string,last:string>>, "
    "abstract string, year int, venue string"
)
ATOM_ENTRY = (
    "id string, title string, summary string, published string, author array<struct<name:string>>"
)
SEARCH_PAYLOAD = (
    "data array<struct<paperId:string,title:string,abstract:string,year:int,"
    "authors:array<struct<name:string>>>>"
)
QUERY_LEDGER = "query string"

PAPERS = (
    "paper_id string, title string, abstract string, authors array<string>, source string, year int"
)
REJECTED = (
    "title string, abstract string, authors array<string>, year int, source string, reason string"
)
AUTHOR_STATS = "author string, paper_count bigint, year int"
TEMPORAL_TOPICS = "token string, count bigint, year int"
COLLABORATIONS = "author1 string, author2 string, weight bigint"

CITATIONS = (
    "string string, label string, citingPaperId string, citedPaperId string, "
    "sectionName string, isKeyCitation boolean, citingPaperTitle string"
)
CITATION_REPLY = (
    "data array<struct<contexts:array<string>,citingPaper:struct<paperId:string,title:string,"
    "year:int,abstract:string,authors:array<struct<authorId:string>>>>>"
)
CITATION_PAYLOAD = f"hop1_id string, {CITATION_REPLY}"
HOP2_EDGES = (
    "hop1_paper_id string, hop2_paper_id string, hop2_title string, hop2_year int, "
    "hop2_abstract string, hop2_author_ids string, citation_context string"
)
HOP0 = "source_paper_id string, title string, abstract string, year int, authors string"
HOP1 = (
    "hop1_id string, hop0_id string, hop1_title string, hop1_abstract string, hop1_year int, "
    "intent_label string, citation_text string"
)
HOP2 = (
    "hop2_id string, hop1_id string, hop2_title string, hop2_abstract string, hop2_year int, "
    "citation_text string"
)
OPENALEX_REPLY = (
    "results array<struct<publication_year:int,"
    "abstract_inverted_index:map<string,array<int>>,"
    "authorships:array<struct<author:struct<id:string,display_name:string>>>>>"
)
CROSSREF_REPLY = (
    "message struct<items:array<struct<issued:struct<`date-parts`:array<array<int>>>,"
    "abstract:string,author:array<struct<ORCID:string,given:string,family:string>>>>>"
)
AUTHOR_REPLY = "array<struct<authors:array<struct<authorId:string,name:string>>>>"
METADATA_REPLY = (
    "array<struct<paperId:string,title:string,year:int,abstract:string,"
    "authors:array<struct<authorId:string,name:string>>>>"
)
PAPER_AUTHORS = "paper_id string, author_id string, author_name string, source string"
EDGE_PREDICTIONS = (
    "citing_paper_idx bigint, cited_paper_idx bigint, citing_paper_id string, "
    "cited_paper_id string, predicted_intent string, raw_importance double, delta_t double"
)
TRAINING_LOG = "epoch bigint, loss double, accuracy double, lambda double"
