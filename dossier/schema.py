"""Column types of tokens, spans and records."""

TOKENS = "array<struct<entity:string,word:string,start:int,end:int,score:double>>"
SPAN = "struct<label:string,text:string,start:int,end:int,bio:string,score:double>"
SPANS = f"array<{SPAN}>"
EXPERIENCE = "struct<title:string,company:string,start_date:string,end_date:string>"
EDUCATION = "struct<degree:string,field:string,institution:string>"
CHUNKS = "array<struct<text:string,offset:int>>"
LABELS = ("NAME", "EMAIL", "PHONE", "LOCATION", "COMPANY", "TITLE", "DATE", "DEGREE", "INSTITUTION", "FIELD", "SKILL", "CERT", "LANGUAGE")
