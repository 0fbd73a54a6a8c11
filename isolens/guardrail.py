"""A session that runs only statements which act for the tenant of their context."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, Row, SparkSession

from isolens.functions import statements as st
from isolens.operators.rowfilter import as_query, spark_text

_tenant: ContextVar[str | None] = ContextVar("tenant", default=None)


class GuardrailError(Exception):
    """A statement that was not run."""


class NoTenantContext(GuardrailError):
    pass


class UnscopedQuery(GuardrailError):
    pass


class WrongTenant(GuardrailError):
    pass


class Unattributable(GuardrailError):
    pass


@contextmanager
def with_tenant(tenant: str) -> Iterator[None]:
    token = _tenant.set(tenant)
    try:
        yield
    finally:
        _tenant.reset(token)


def tenant_from_context() -> str | None:
    """The tenant in force; an empty one counts as none."""
    return _tenant.get() or None


class GuardedSession:
    """sql() and first() run queries, execute() writes; a statement's text and parameters are checked before the session sees them.

    Nothing else of the session is offered.
    """

    def __init__(self, spark: SparkSession, classes: dict[str, tuple[str, str | None]]) -> None:
        self.__spark, self.__classes = spark, dict(classes)

    def check(self, sql: str, args: Sequence[Any] = (), tenant: str | None = None) -> None:
        tenant = tenant or tenant_from_context()
        if not tenant:
            raise NoTenantContext("no tenant in context")
        params = [st.Param.of(None if a is None else str(a)) for a in args]
        found = st.check_tenant(sql, self.__classes, params, tenant)
        if found.verdict == "UNATTRIBUTABLE":
            raise Unattributable(found.reason)
        if found.verdict == st.LEAK:
            raise UnscopedQuery(found.reason) if found.reason.startswith("no ") else WrongTenant(found.reason)

    def sql(self, sql: str, args: Sequence[Any] = (), tenant: str | None = None) -> DataFrame:
        """A query's rows; commands are refused, as they do not parse as a subquery."""
        self.check(sql, args, tenant)
        try:
            self.__run(as_query(sql), args)
        except ParseException as e:
            raise Unattributable("not a query") from e
        return self.__run(spark_text(sql), args)

    def first(self, sql: str, args: Sequence[Any] = (), tenant: str | None = None) -> Row | None:
        """A query's first row, None if it has none."""
        return self.sql(sql, args, tenant).first()

    def execute(self, sql: str, args: Sequence[Any] = (), tenant: str | None = None) -> None:
        """Runs a write."""
        self.check(sql, args, tenant)
        if not st.is_write(sql):
            raise Unattributable("not a write")
        self.__run(spark_text(sql), args)

    def __run(self, sql: str, args: Sequence[Any]) -> DataFrame:
        return self.__spark.sql(sql, args={f"p{i}": a for i, a in enumerate(args, 1)})
