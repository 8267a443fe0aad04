"""Schemas of the engine's tables, as DDL strings that every reader and empty result uses."""

FILING = "ticker string, cik string, accession string, filename string"
SECTION = "ticker string, text string"
CHUNK = "chunk_id string, ticker string, section string, page_estimate bigint, start_word bigint, end_word bigint, text string"
NODE = "id string, label string, ticker string, cik string, name string, text string, objective_type string, status string, risk_category string, ord bigint"
EDGE = "src string, dst string, rel string, ord bigint"
RECORD = (
    "Company struct<ticker:string,cik:string>, Mission struct<text:string>, "
    "StrategicObjective array<struct<text:string,objective_type:string>>, Capability array<struct<name:string>>, "
    "Initiative array<struct<name:string,status:string>>, RiskTheme array<struct<name:string,risk_category:string>>, "
    "Edges array<array<string>>"
)
VECTOR = "vec_id bigint, embedding array<double>"
COMPANY = "ticker string, name string, fiscal_year string, category string, mission string, alignment_label string, alignment_rationale string, cik string"
SCORE = "ticker string, dimension string, score int"
ONTOLOGY_EDGE = "edge string, domain string, range string"

#: Column names that the CSV files use, in the order of the tables above.
NODE_HEADER = {"id": ":ID", "label": ":LABEL"}
EDGE_HEADER = {"src": ":START_ID", "dst": ":END_ID", "rel": ":TYPE"}
