import pyarrow as pa
import pytest

from loomlog.errors import LoomError
from loomlog.operators.graph import Graph
from loomlog.plans import external, logical
from loomlog.plans import syntax as s
from loomlog.plans.external import Failure, Prepared, Resolver
from loomlog.sources import text
from tests.conftest import rows
from tests.test_engine import ALICE, code


@pytest.fixture(scope="module")
def likes(spark):
    return Graph.empty(spark).insert([*ALICE, s.Edge("vertex/bob", "graph/likes", "vertex/alice"), s.Edge("vertex/eve", "graph/likes", "vertex/bob")])


class Provider:
    def __init__(self, answer):
        self.answer, self.requests = answer, []

    def __call__(self, request):
        self.requests.append(request)
        return self.answer(request) if callable(self.answer) else self.answer


def accounts(request):
    return [{"person_id": k["person_id"], "account_id": f"account-{k['person_id'][-1]}"} for k in request.keys]


def materialized(likes, answer, query='edge(p, "graph/likes", "vertex/bob"), crmAccount(p, account)'):
    provider = Provider(answer)
    catalog = likes.catalog()
    catalog.external("crmAccount", ("person_id", "account_id"), Resolver("materialize_before_sql", "crm", ("person_id",), materialize_rows=provider))
    return Prepared(catalog, text.parse_query(query)), provider


def test_pushdown(spark, likes):
    catalog = likes.catalog()
    table = catalog.table("stored", spark.createDataFrame([("vertex/alice", "account-1")], "person_id string, account_id string"))
    catalog.external("crmAccount", table.columns, Resolver("sql_pushdown", "crm", ("person_id",)), table)
    assert rows(Prepared(catalog, text.parse_query("vertex(p), crmAccount(p, a)")).run()) == [("vertex/alice", "account-1")]
    assert code(catalog.external, "x", ("a",), Resolver("sql_pushdown", "crm", ("a",))) == "UNSUPPORTED_GRAPH_PREDICATE"


def test_materialize_asks_once_with_distinct_keys(likes):
    prepared, provider = materialized(likes, accounts)
    assert rows(prepared.run()) == [("vertex/alice", "account-e"), ("vertex/eve", "account-e")]
    assert len(provider.requests) == 1
    assert sorted(k["person_id"] for k in provider.requests[0].keys) == ["vertex/alice", "vertex/eve"]
    constant, provider = materialized(likes, accounts, 'crmAccount("vertex/bob", account)')
    assert rows(constant.run()) == [("account-b",)] and len(provider.requests) == 1


def test_same_predicate_twice_binds_each(likes):
    prepared, provider = materialized(likes, accounts, 'edge(p, "graph/likes", o), crmAccount(p, a), crmAccount(o, b)')
    assert ("vertex/alice", "vertex/bob", "account-e", "account-b") in rows(prepared.run())
    assert len(provider.requests) == 2


@pytest.mark.parametrize(
    "answer, want",
    [
        ([], "EXTERNAL_PROVIDER_FAILURE"),
        (Failure("EXTERNAL_PROVIDER_TIMEOUT", "slow"), "EXTERNAL_PROVIDER_TIMEOUT"),
        (lambda r: accounts(r) * 2, "EXTERNAL_DUPLICATE_KEY"),
        (lambda r: [{"person_id": k["person_id"]} for k in r.keys], "EXTERNAL_ROW_SHAPE_MISMATCH"),
        ([{"person_id": "other", "account_id": "x"}], "EXTERNAL_PROVIDER_FAILURE"),
    ],
)
def test_provider_failures(likes, answer, want):
    assert code(materialized(likes, answer)[0].run) == want


def test_override_for_one_run(likes):
    prepared, provider = materialized(likes, [])
    assert prepared.run(load_rows=accounts).count() == 2 and not provider.requests


def test_keys_must_be_bound(likes):
    assert code(materialized, likes, accounts, 'crmAccount(p, a), edge(p, "graph/likes", "x")') == "EXTERNAL_SELECT_FACTS_UNBOUND_MATERIALIZATION_KEY"
    assert code(materialized, likes, accounts, "vertex(v), crmAccount(_, a)") == "EXTERNAL_SELECT_FACTS_UNBOUND_MATERIALIZATION_KEY"
    assert code(materialized, likes, accounts, "vertex(p), crmAccount(p, a), not vertex(a)") == "EXTERNAL_SELECT_FACTS_UNSUPPORTED_NEGATION"


def test_batches_on_the_executors(likes):
    catalog = likes.catalog()
    ask = lambda keys: pa.table({"p": keys["p"], "n": pa.array([len(x) for x in keys["p"].to_pylist()], pa.int64())})
    catalog.external("size", ("p", "n"), Resolver("materialize_before_sql", "len", ("p",), batch_rows=ask, column_types={"n": "int8"}))
    assert rows(Prepared(catalog, text.parse_query('edge(p, "graph/likes", _), size(p, n)')).run()) == [("vertex/alice", 12), ("vertex/bob", 10), ("vertex/eve", 10)]


def hydrated(likes, answer, query='edge(p, "graph/likes", o), profile(o, _)', columns=("o", "text")):
    provider = Provider(answer)
    catalog = likes.catalog()
    catalog.external("profile", columns, Resolver("post_query_hydrate", "crm", ("o",), hydrate_rows=provider, hydrated_field="story"))
    return Prepared(catalog, text.parse_query(query)), provider


def test_hydration_keeps_rows(likes):
    prepared, provider = hydrated(likes, lambda r: [{"o": k["o"], "text": f"profile:{k['o']}"} for k in r.keys])
    assert rows(prepared.run()) == [("vertex/alice", "vertex/bob", "profile:vertex/bob"), ("vertex/bob", "vertex/alice", "profile:vertex/alice"), ("vertex/eve", "vertex/bob", "profile:vertex/bob")]
    assert len(provider.requests) == 1 and len(provider.requests[0].keys) == 2
    several, _ = hydrated(likes, lambda r: [{"o": k["o"], "a": "1", "b": "2"} for k in r.keys], 'edge(p, "graph/likes", o), profile(o, _, _)', ("o", "a", "b"))
    assert several.run().first().story.asDict() == {"a": "1", "b": "2"}


def test_hydration_of_nothing_asks_nobody(likes):
    prepared, provider = hydrated(likes, [], 'edge("none", "p", o), profile(o, _)')
    assert prepared.run().isEmpty() and not provider.requests


def test_hydration_failures(likes):
    assert code(hydrated(likes, [])[0].run) == "EXTERNAL_PROVIDER_FAILURE"
    assert code(hydrated(likes, lambda r: [{"o": k["o"]} for k in r.keys])[0].run) == "EXTERNAL_ROW_SHAPE_MISMATCH"
    assert code(hydrated(likes, lambda r: [{"o": k["o"], "text": "x"} for k in r.keys] * 2)[0].run) == "EXTERNAL_DUPLICATE_KEY"
    assert code(hydrated, likes, [], 'edge(p, "graph/likes", _), profile(o, _)') == "EXTERNAL_SELECT_FACTS_UNPROJECTED_HYDRATION_KEY"
    assert code(hydrated, likes, [], "profile(o, _)") == "UNSUPPORTED_GRAPH_PREDICATE"


def test_resolver_definitions():
    rows_ = lambda r: []
    assert code(Resolver, "sql_pushdown", "x", ("a", "a")) == "EXTERNAL_RESOLVER_INVALID_KEY_COLUMNS"
    assert code(Resolver, "sql_pushdown", "x", ("a",), materialize_rows=rows_) == "EXTERNAL_RESOLVER_INVALID_HANDLER_COMBINATION"
    assert code(Resolver, "materialize_before_sql", "x", ("a",)) == "EXTERNAL_RESOLVER_INVALID_HANDLER_COMBINATION"
    assert code(Resolver, "post_query_hydrate", "x", ("a",), hydrate_rows=rows_) == "EXTERNAL_RESOLVER_INVALID_HYDRATED_FIELD_NAME"
    assert code(Resolver, "materialize_before_sql", "x", ("a",), materialize_rows=rows_, hydrated_field="f") == "EXTERNAL_RESOLVER_INVALID_HYDRATED_FIELD_NAME"
    assert external.MODES["post_query_hydrate"] == (False, False, True)


def test_plans_that_may_not_read_external_predicates(likes):
    catalog = likes.catalog()
    with pytest.raises(LoomError):
        catalog.external("x", ("a",), Resolver("materialize_before_sql", "x", ("b",), materialize_rows=lambda r: []))
    catalog.external("x", ("a",), Resolver("materialize_before_sql", "x", ("a",), materialize_rows=lambda r: []))
    scan = logical.Scan("x", 1, "x")
    assert code(logical.check_external, scan, catalog, True) == "EXTERNAL_SELECT_FACTS_UNSUPPORTED_MUTATION"
    assert code(logical.check_external, logical.Aggregate(scan, (), (("n", "count", None),)), catalog) == "EXTERNAL_SELECT_FACTS_UNSUPPORTED_AGGREGATE"
    assert code(logical.check_external, logical.Materialize(scan, reason="recursive-frontier"), catalog) == "EXTERNAL_SELECT_FACTS_UNSUPPORTED_RECURSION"
    logical.check_external(scan, catalog)
