"""The SELECT dialect: text to checked query to DataFrame."""

from stratafold.sql.parser import SqlError, parse
from stratafold.sql.translator import SqlQuery, execute, translate

__all__ = ["SqlError", "SqlQuery", "execute", "parse", "translate"]
