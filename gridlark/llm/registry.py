"""What __spark_entry__.py registers from this subpackage."""

from gridlark.llm import queries
from gridlark.llm.oracles import ORACLES

QUERIES = {name: f for name, f in vars(queries).items() if name.startswith("op")}

__all__ = ["ORACLES", "QUERIES"]
