"""Small codecs: JSON frames with an operation code, integrity hashes, request ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import QueryError


class Frames:
    """Operations by code, each with the schema of its body (as DDL)."""

    def __init__(self) -> None:
        self.schemas: dict[str, str] = {}

    def register(self, opcode: str, schema: str) -> None:
        if opcode in self.schemas:
            raise ValueError(f"the code {opcode} is taken")
        self.schemas[opcode] = schema

    def encode(self, opcode: str, body: Column) -> Column:
        """``{"opcode": ..., "body": ...}`` of a struct column."""
        if opcode not in self.schemas:
            raise QueryError(f"unknown code {opcode}", "frame")
        return F.to_json(F.struct(F.lit(opcode).alias("opcode"), body.alias("body")))

    def opcode(self, frame: Column) -> Column:
        """The code of a frame; null if it is not registered or the frame is no JSON."""
        found = F.get_json_object(frame, "$.opcode")
        return F.when(found.isin(sorted(self.schemas)), found)

    def body(self, opcode: str, frame: Column) -> Column:
        """The body of a frame of this code as a struct; null for others."""
        if opcode not in self.schemas:
            raise QueryError(f"unknown code {opcode}", "frame")
        return F.when(self.opcode(frame) == opcode, F.from_json(F.get_json_object(frame, "$.body"), self.schemas[opcode]))


def integrity(hex_digest: Column, algorithm: str = "sha256") -> Column:
    """The value of an ``integrity`` attribute from a digest in hexadecimal."""
    return F.concat(F.lit(f"{algorithm}-"), F.base64(F.unhex(hex_digest)))


def request_id() -> Column:
    """32 hexadecimal digits, different for each row."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))
