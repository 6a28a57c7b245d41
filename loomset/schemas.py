"""Explicit schemas for every kind of table the library reads or writes."""

MESSAGES = "array<struct<role:string,content:string>>"
TURNS_FROM_VALUE = "array<struct<`from`:string,value:string>>"

CHAT = f"messages {MESSAGES}"
IDENTITY = f"conversations {TURNS_FROM_VALUE}"
PAIRS = f"chosen {MESSAGES}, rejected {MESSAGES}"
MATH_RAW = "question string, answer string"
TEXT_TO_SQL = "context string, question string, answer string"
