"""Column functions for command lines, process names and log text."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that class a process or a command line.
SYSTEM_PROCESSES = ["svchost", "explorer", "system", "services", "lsass", "csrss"]
SHELL_PROCESSES = ["bash", "sh", "cmd", "powershell", "python", "perl", "ruby"]
SUSPICIOUS_COMMANDS = ["wget", "curl", "nc", "netcat", "powershell -enc", "base64", "eval"]
ROOT_USERS = ["root", "administrator", "0"]

# A parent containing one word of the left list starting a child
# containing one word of the right list is unusual.
UNUSUAL_CHILDREN = [
    (["explorer"], ["cmd", "powershell", "bash"]),
    (["word", "excel"], ["cmd", "powershell"]),
    (["iexplore", "chrome"], ["cmd", "powershell"]),
]


def has_any(text: Column, words: list[str]) -> Column:
    """Whether the text contains one of the words, in one regex pass."""
    return text.rlike("|".join(re.escape(w) for w in words))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def flag(condition: Column) -> Column:
    """Boolean to 0/1 with NULL as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def first_filled(*texts: Column) -> Column:
    """The first text that is neither NULL nor empty."""
    return F.coalesce(*[blank_to_null(t) for t in texts])


def unusual_child(parent: Column, child: Column) -> Column:
    parent, child = F.lower(parent), F.lower(child)
    hit = F.lit(False)
    for parents, children in UNUSUAL_CHILDREN:
        hit = hit | (has_any(parent, parents) & has_any(child, children))
    return flag(hit)
