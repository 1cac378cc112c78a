"""Source extracts derived from the test tables, as text columns like the delivered files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


PRODUCTS = (
    "Broadband",
    "Hosted Voice",
    "Cloud Backup",
    "IT Support",
    "Office Licences",
    "Rack Space",
)
CATEGORIES = ("Network", "Telephony", "Email", "Hardware", "Access", "Billing", "Other")
# What user turns open with: nothing, one of the five intents, or two of them.
OPENINGS = (
    "",
    "Any churn to fear? ",
    "Who owes us money? ",
    "Is support on time? ",
    "What is our revenue? ",
    "Show the portfolio. ",
    "Churn and unpaid: ",
)
NO_SUCH_CUSTOMER = "CUST9999999999"


def _pick(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(n) for n in names)), (index + 1).cast("int"))


def _iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose rows take much work, in a task for each core at least: a test table is one row group.

    A table whose rows are read in that many tasks anyway stays where it is. Parts of a file count by their rows:
    a row group goes to one task, whatever number of parts its file is cut into.
    """
    rows, cores = table(spark, folder, name).select(*columns), spark.sparkContext.defaultParallelism
    parts = rows.rdd.getNumPartitions()
    if parts >= cores:
        held = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))  # read from footers
        most, every = held.agg(F.max("n"), F.sum("n")).first()
        if not every or most * cores <= 2 * every:
            return rows
    return rows.repartition(max(parts, cores), F.col(columns[0]))


def crm(spark: SparkSession, folder: str) -> DataFrame:
    customers = spread_table(spark, folder, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    key = F.col("c_custkey")
    since = F.date_add(F.lit("1995-01-01").cast("date"), (key % 2200).cast("int"))
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.format_string("C-%04d", key).alias("Account ID"),
        F.col("c_name").alias("Company"),
        F.col("c_mktsegment").alias("Sector"),
        F.concat(F.lit("Town "), F.col("c_nationkey").cast("string")).alias("Town"),
        F.format_string("contact%d@mail.example", key).alias("Primary Contact Email"),
        F.col("n_name").alias("Account Manager"),
        F.date_format(since, "dd/MM/yyyy").alias("Customer Since"),
        (key % 396 + 5).cast("string").alias("Seats"),
    )


def billing(spark: SparkSession, folder: str, dirty: bool) -> DataFrame:
    key = F.col("o_orderkey")
    issued = F.trunc(F.col("o_orderdate").cast("date"), "quarter")
    paid = F.date_add(issued, (key % 60 + 5).cast("int"))
    open_order = (F.col("o_orderstatus") == "O") & (
        F.col("o_orderdate") >= F.lit("2000-07-01").cast("timestamp_ntz")
    )
    customer = F.format_string("CUST%04d", F.col("o_custkey"))
    amount = F.concat(F.lit("£"), F.format_number(F.floor("o_totalprice") / F.lit(100), 2))
    if dirty:
        customer = (
            F.when(key % 89 == 0, F.lit(NO_SUCH_CUSTOMER))
            .when(key % 151 == 0, F.concat(F.lit("BAD-"), key.cast("string")))
            .otherwise(customer)
        )
        amount = F.when(key % 97 == 0, F.lit("£1,2O4.00")).otherwise(amount)
    orders = spread_table(
        spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"
    )
    return orders.select(
        F.concat(F.lit("INV"), key.cast("string")).alias("invoice_no"),
        customer.alias("cust_ref"),
        _pick(PRODUCTS, key % len(PRODUCTS)).alias("product_line"),
        amount.alias("net_amount"),
        F.date_format(issued, "yyyy-MM-dd").alias("issued"),
        F.when(open_order, F.lit("")).otherwise(F.date_format(paid, "yyyy-MM-dd")).alias("paid_on"),
    )


def service_desk(spark: SparkSession, folder: str, dirty: bool) -> DataFrame:
    key, user = F.col("event_id"), F.col("user_id")
    days = (key % (F.lit(60) + F.lit(40) * (user % 4))).cast("int")
    seconds = F.floor(F.col("value") * 1200).cast("int")
    second = F.date_trunc("second", "ts").cast("timestamp_ntz")
    opened = second - F.make_dt_interval(days=days)
    resolved = opened + F.make_dt_interval(secs=seconds)
    client = user.cast("string")
    if dirty:
        client = F.when(key % 113 == 0, F.lit("unknown")).otherwise(client)
    events = spread_table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")
    errors = events.filter(F.col("event_type") == "error")
    return errors.select(
        key.cast("string").alias("ticket_id"),
        client.alias("client"),
        F.concat(F.lit("P"), (key % 4 + 1).cast("string")).alias("priority"),
        _pick(CATEGORIES, key % len(CATEGORIES)).alias("category"),
        F.format_string("Reported by contact%d@mail.example", user).alias("summary"),
        _iso(opened).alias("opened_at"),
        F.when(key % 12 != 0, _iso(resolved)).alias("resolved_at"),
        F.when(key % 5 != 0, (key % 5 + 1).cast("string")).alias("csat"),
    )


def network(spark: SparkSession, folder: str) -> DataFrame:
    outage = F.when(F.col("user_id") % 4 == 0, 60).otherwise(6)
    month = F.add_months(F.lit("2023-02-01").cast("date"), (F.col("event_id") % 12).cast("int"))
    usage = (
        table(spark, folder, "events")
        .groupBy("user_id", F.date_format(month, "yyyy-MM").alias("period"))
        .agg(
            F.count("*").alias("events"),
            F.sum("value").alias("gb"),
            F.sum(F.when(F.col("event_type") == "error", outage).otherwise(0)).alias("outage"),
        )
    )
    return usage.select(
        F.format_string("NB/%04d", "user_id").alias("acct"),
        "period",
        F.col("events").cast("string").alias("voice_minutes"),
        F.format_string("%.2f", F.col("gb")).alias("data_gb"),
        F.col("outage").cast("string").alias("outage_minutes"),
    )


def user_questions(spark: SparkSession, folder: str) -> DataFrame:
    turns = spread_table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    opening = _pick(OPENINGS, (F.col("conv_id") + F.col("turn")) % len(OPENINGS))
    return turns.filter(F.col("role") == "user").select(
        F.concat_ws("/", "conv_id", "turn").alias("question_id"),
        F.concat(opening, "text").alias("question"),
    )


def extracts(spark: SparkSession, folder: str, dirty: bool = False) -> dict[str, DataFrame]:
    """All four extracts; ``dirty`` plants unreadable amounts, bad keys and orphans."""
    return {
        "crm": crm(spark, folder),
        "billing": billing(spark, folder, dirty),
        "servicedesk": service_desk(spark, folder, dirty),
        "network": network(spark, folder),
    }


def deliver_files(spark: SparkSession, frames: dict[str, DataFrame], folder: str, mapping: dict[str, dict]) -> dict[str, dict]:
    """Write extracts as their systems deliver them, CSV or JSON lines in folders of files; the mapping to read them by."""
    delivered = {}
    for name, source in mapping.items():
        path = f"{folder}/{source['file']}"
        if source["format"] == "csv":
            frames[name].write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="")
        else:
            frames[name].write.option("ignoreNullFields", False).json(path)
        delivered[name] = source | {"layout": "lines"}
    return delivered


def deliver_markdown(documents: DataFrame, folder: str) -> int:
    """Write documents (doc, text) as Markdown files, one each; how many."""
    spark = documents.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                with store.open_output_stream(f"{top}/{doc}.md") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    return documents.selectExpr("CAST(doc AS string) AS doc", "text").mapInArrow(run, "files long").groupBy().sum("files").first()[0]
