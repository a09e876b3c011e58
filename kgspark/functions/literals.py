"""Classes of literal strings by anchored patterns, tried in a fixed order; all expressions stay in the JVM.

Quirks that callers rely on are kept: unit suffixes of decimals need not end the string, December is spelt ``dicember``,
grouped integers are dates, an exponent needs its sign.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define the classes, in the order in which they are tried, and what each class maps to.
DATETIME = r"^\d{4}[-.\/]\d{1,2}[-.\/]\d{1,2}T(24:00|2[0-3]:[0-5][0-9]|[0-1][0-9]:[0-5][0-9])$"
TIME = r"^(24:00|2[0-3]:[0-5][0-9]|[0-1][0-9]:[0-5][0-9])$"
URL = r"^((http|https)\:\/\/)?[a-zA-Z0-9\.\/\?\:@\-_=#]+\.([a-zA-Z]){2,6}([a-zA-Z0-9\.\&\/\?\:@\-_=#])$"
EMAIL = r"^\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b$"
FLOAT = (
    r"^[-+]?\d+[\,\.]\d+$|"
    r"^[-+]?\d+[\,\.]\d+[eE][-+]\d+$|"
    r"^[-+]?\d+[\,\.]\d+[ ]+(km|km2|m|sq|mi|cm|cm2|mm|dm|ft)|"
    r"^\d+[ ]+(km|km2|m|sq|mi|cm|cm2|mm|dm|ft)"
)
INTEGER = (
    r"^[-+]?\d+$|"
    r"^\d+[ –-](thousand|million|billion|trillion)$|"
    r"^\d+[\,\.]\d+[ –-](thousand|million|billion|trillion)$"
)
DATE = (
    r"^\d{1,4}[\,\.\s\t\n]+bc$|"
    r"^\d{4}[-.\/]\d{1,2}[-.\/]\d{1,2}$|"
    r"^\d{1,2}[-.\/]\d{1,2}[-.\/]\d{4}$|"
    r"^\d{1,2}[-.\/]\d{1,2}[-.\/]\d{2}$|"
    r"^(january|february|march|april|may|june|july|august|september|october|november|dicember)[\.\,\s\t\n\/]+\d{1,2}[\.\,\s\t\n\/]+\d{4}$|"
    r"^\d{1,2}[\.\,\s\t\n\/]+(january|february|march|april|may|june|july|august|september|october|november|dicember)[\.\,\s\t\n\/]+\d{4}$|"
    r"^\d{4}[\.\,\s\t\n\/]+(january|february|march|april|may|june|july|august|september|october|november|dicember)[\.\,\s\t\n\/]+\d{1,2}$|"
    r"^\d{4}[\.\,\s\t\n\/]+\d{1,2}[\.\,\s\t\n\/]+(january|february|march|april|may|june|july|august|september|october|november|dicember)$|"
    r"^(january|february|march|april|may|june|july|august|september|october|november|dicember)[\.\,\s\n\t\/]+\d{4}$|"
    r"^\d{4}[\.\,\s\n\t\/]+(january|february|march|april|may|june|july|august|september|october|november|dicember)$|"
    r"^\d+[\.\,]\d+[\.\,]\d+[\.\,]\d+$|"
    r"^\d+[\.\,]\d+[\.\,]\d+$|"
    r"^\d+[\.\,]\d+$|"
    r"^\d{4}[–-]\d{4}$|"
    r"^\d{4}[–-](present|now)$|"
    r"^\d{4}$|"
    r"^\d+$"
)
PATTERNS = {"DATETIME": DATETIME, "TIME": TIME, "URL": URL, "EMAIL": EMAIL, "FLOAT": FLOAT, "INTEGER": INTEGER, "DATE": DATE}
#: class -> (group, tag, XML type)
CLASSES = {
    "DATE": ("DATETIME", "LIT", "xsd:date"), "DATETIME": ("DATETIME", "LIT", "xsd:dateTime"), "TIME": ("DATETIME", "LIT", "xsd:time"), "URL": ("STRING", "LIT", "xs:anyURI"),
    "EMAIL": ("STRING", "LIT", "xsd:string"), "INTEGER": ("NUMBER", "LIT", "xsd:integer"), "FLOAT": ("NUMBER", "LIT", "xsd:decimal"), "STRING": ("STRING", "NE", "xsd:string"),
}


def literal_class(token: Column) -> Column:
    found = None
    for name, pattern in PATTERNS.items():
        hit = token.rlike("(?iuU)" + pattern)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found.otherwise("STRING")


def described(name: Column, field: int) -> Column:
    """Group (0), tag (1) or XML type (2) of a class."""
    found = None
    for key, values in CLASSES.items():
        found = F.when(name == key, values[field]) if found is None else found.when(name == key, values[field])
    return found


#: ISO dates and times: year, month or day, extended or basic, with a time and a zone behind a day.
ISO = r"^\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01])(T([01]\d|2[0-4])(:[0-5]\d(:[0-5]\d([.,]\d{1,6})?)?)?(Z|[-+]\d{2}(:?\d{2})?)?)?)?|(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01]))?$"
NUMBER = r"(?i)^\s*[-+]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?(?:e[-+]?\d+)?|\.\d+(?:e[-+]?\d+)?|nan|inf|infinity)\s*$"


def value_type(v: Column) -> Column:
    """DATETIME, NUMBER or STRING of a table cell."""
    return F.when(v.rlike(ISO), "DATETIME").when(v.rlike(NUMBER), "NUMBER").otherwise("STRING")
