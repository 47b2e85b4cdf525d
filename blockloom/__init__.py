"""Block-structured compressed data as Spark tables.

Byte payloads are cut, deflated as independent blocks inside ordinary gzip members, found
again in whatever layout they come, inflated in parallel and verified, all as DataFrame
operators. See README.md."""

__version__ = "0.1.0"
