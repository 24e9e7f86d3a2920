"""Inputs derived from the given tables, written once as SQL expressions that Spark and
the checking database both run. Every derivation keeps all rows of its source table."""

from pyspark.sql import DataFrame, SparkSession

from clausegrid.sources.tables import read


class Derived:
    """A projection of one given table: a DataFrame in Spark, a CTE in the check SQL."""

    def __init__(self, name: str, source: str, **columns: str):
        self.name, self.source, self.columns = name, source, columns

    def df(self, spark: SparkSession, folder: str) -> DataFrame:
        return read(spark, folder, self.source).selectExpr(*[f"{e} as {n}" for n, e in self.columns.items()])

    @property
    def cte(self) -> str:
        return f"{self.name} as (select " + ", ".join(f"{e} as {n}" for n, e in self.columns.items()) + f" from {self.source})"


CLAUSE_TEXT = """concat('Orders above ',
    case when o_orderkey % 3 = 0 then 'NGN' when o_orderkey % 3 = 1 then 'USD' else 'EUR' end, ' ',
    cast(cast(floor(o_totalprice) as bigint) as string), ' must have ',
    case substring(o_orderpriority, 1, 1) when '1' then 'CEO' when '2' then 'CFO'
      when '3' then 'Director' when '4' then 'Manager' else 'Lead' end,
    ' approval within ', cast(o_orderkey % 90 + 1 as string), ' days. ',
    'Purchase records shall be kept under ',
    case o_orderkey % 4 when 0 then 'GDPR' when 1 then 'NDPA' when 2 then 'SOX' else 'HIPAA' end, '.')"""

# Some clauses are shorter than any length limit, some lie between the limits, some are
# longer than every cut, so each side of those rules has rows.
CLAUSE_OF_ANY_LENGTH = f"""case when o_orderkey % 23 = 5 then 'Keep it.'
    when o_orderkey % 29 = 3 then concat('Manager approval of order ', cast(o_orderkey as string))
    when o_orderkey % 31 = 4 then repeat(concat({CLAUSE_TEXT}, ' '), 6) else {CLAUSE_TEXT} end"""

CLAUSES = Derived(
    "clauses", "orders",
    clause_id="o_orderkey", ord="o_orderkey", document_id="o_custkey",
    section_path="concat(cast(o_orderkey % 2 + 1 as string), ' > ', cast(o_orderkey % 5 as string))",
    clause_ref="concat(cast(o_orderkey % 2 + 1 as string), ' Purchase > Rule ', cast(o_orderkey % 9 as string))",
    version="case when o_orderkey % 11 = 0 then null else 'v1' end",
    text=CLAUSE_OF_ANY_LENGTH,
)

# Two formats: styled lines (even documents) and plain lines (odd documents).
POLICY_LINES = Derived(
    "policy_lines", "orders",
    document_id="o_custkey", ord="o_orderkey", page="cast(o_orderkey % 50 + 1 as int)",
    format="case when o_custkey % 2 = 0 then 'docx' else 'pdf' end",
    style="case when o_orderkey % 7 = 0 then 'Heading 1' when o_orderkey % 7 = 3 then 'Heading 2' "
          "when o_orderkey % 7 = 5 then 'Heading 3' else 'Normal' end",
    text="case when o_orderkey % 7 = 0 then concat('PURCHASE RULES ', cast(o_orderkey as string)) "
         "when o_orderkey % 7 = 3 then concat('1. Limits ', cast(o_orderkey as string)) "
         "when o_orderkey % 7 = 5 then concat('2. Part A.', cast(o_orderkey as string)) "
         "when o_orderkey % 13 = 1 then '   ' "
         f"else concat('  ', {CLAUSE_TEXT}, ' ') end",
)

# Two tables of a document never share an order key; the cells arrive as nested arrays.
POLICY_TABLES = Derived(
    "policy_tables", "orders",
    document_id="o_custkey", table_no="o_orderkey",
    cell_1="concat(' ', o_orderstatus, ' ')", cell_2="o_orderpriority",
    cell_3="case when o_orderkey % 17 = 0 then ' ' else cast(o_orderkey as string) end",
)

POLICIES = Derived(
    "policies", "customer",
    document_id="c_custkey", ord="c_custkey",
    title="case when c_custkey % 10 = 7 then c_name "
          "else concat(c_mktsegment, ' ', cast(c_custkey % 40 as string), ' Policy') end",
    version="case when c_custkey % 6 = 5 then null when c_custkey % 4 < 2 then 'v1' else 'v2' end",
    status="case when c_custkey % 9 = 8 then null else 'active' end",
    department="c_mktsegment",
)

DOCUMENT_STATUS = Derived(
    "document_status", "documents",
    document_id="doc_id", title="concat('Document ', cast(doc_id as string))", lang="lang",
    status="case when doc_id % 10 = 0 then 'archived' else 'active' end",
)

QUESTIONS = Derived("questions", "benchmark", query_id="item_id", question="text")

ASKED = Derived(
    "asked", "orders",
    query_id="o_orderkey", document_id="o_custkey",
    question="case o_orderkey % 5 "
             "when 0 then concat('Who can approve a purchase over $', cast(o_totalprice as string), '?') "
             "when 1 then concat('Is there a conflict on travel above ', cast(cast(floor(o_totalprice) as bigint) as string), ' in the old version') "
             "when 2 then 'Must we follow GDPR when a vendor contract is signed' "
             "when 3 then concat('How do I claim an amount of ', cast(cast(floor(o_totalprice) as bigint) as string)) "
             "else concat('Tell me about ', o_orderpriority, ' and 300 dollars') end",
    role="case substring(o_orderpriority, 1, 1) when '1' then 'CEO' when '2' then 'cfo' "
         "when '3' then 'Director' when '4' then 'manager' else 'Employee' end",
)

# A model's reply to each clause: role as scalar, list or dict, threshold as dict or list
# of dicts, one in ten malformed, some without a role.
REPLY_TEXT = """case when o_orderkey % 10 = 9 then concat('Sorry {"role": ', cast(o_orderkey as string))
  else concat('Here it is: {"role": ',
    case when o_orderkey % 8 = 7 then 'null'
      when o_orderkey % 3 = 0 then '"finance-lead"'
      when o_orderkey % 3 = 1 then '["head of it", "cfo"]'
      else '{"title": "chief officer", "name": "x"}' end,
    ', "department": ', case when o_orderkey % 4 = 1 then 'null' else concat('"dept ', cast(o_custkey % 7 as string), '"') end,
    ', "process": ', case when o_orderkey % 5 = 2 then 'null' else concat('["process ', cast(o_custkey % 20 as string), '"]') end,
    ', "threshold": ', case when o_orderkey % 2 = 0 then '[{"amount": ' else '{"amount": ' end,
    cast(cast(floor(o_totalprice) as bigint) as string), ', "currency": "NGN"', case when o_orderkey % 2 = 0 then '}]' else '}' end,
    ', "regulation": ', case o_orderkey % 6 when 0 then '" gdpr "' when 1 then '"iso 27001"' when 2 then '["sox"]' else 'null' end,
    ', "obligation": ', case when o_orderkey % 3 = 0 then '"mandatory"' else '["optional"]' end, '} Done.') end"""

REPLIES = Derived("replies", "orders", clause_id="o_orderkey", document_id="o_custkey", reply=REPLY_TEXT)
