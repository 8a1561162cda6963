"""Business documents rendered from the order tables, with the fields that they show."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each order: doc_id, gold_type, gold_supplier, gold_date, gold_total, text."""
    first = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_suppkey").alias("sk"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 3).alias("m"), F.col("o_totalprice").alias("p"), F.col("o_orderdate").alias("d"), "o_custkey")
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("c"))
    letter = lambda x: F.char((F.lit(65) + x % 26).cast("int"))
    sk = F.col("sk")
    name = F.when(sk.isNull(), F.lit("Unknown Trading Company")).otherwise(F.concat(letter(sk), letter(F.floor(sk / 26)), letter(F.floor(sk / 676)), F.lit(" Trading Company")))
    # The rows are small but each costs a document's extraction: a stated number of partitions keeps adaptive execution from merging them by bytes.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = orders.join(customer, "o_custkey").repartition(parts, "k").join(first, "k", "left").withColumn("s", name)
    day = lambda pattern: F.date_format("d", pattern)
    number = lambda base: (F.col("k") + base).cast("string")
    amount, lf = F.format_number("p", 2), "\n"
    c, s = F.col("c"), F.col("s")
    invoice = F.concat(F.lit("INVOICE # "), number(10000), F.lit(lf + "Vendor: "), s, F.lit(lf + "Bill To: "), c, F.lit(lf + "Invoice Date: "), day("yyyy-MM-dd"), F.lit(lf + "Balance Due: $"), amount)
    receipt = F.concat(F.lit("Company Name: "), s, F.lit(lf + "RECEIPT" + lf + "Receipt No. R"), number(10000), F.lit(lf + "Date: "), day("dd/MM/yyyy"), F.lit(lf + "TOTAL AMT PAYABLE Rs. "), amount, F.lit(lf + "Payment mode: Card"))
    order = F.concat(F.lit("PURCHASE ORDER" + lf + "PO Number : "), number(5380000000), F.lit(lf + "PO Creation Date : "), day("dd.MM.yyyy"), F.lit(lf + "SUPPLIER: "), s, F.lit(lf + "Grand Total "), amount)
    by_kind = lambda a, b, d: F.when(F.col("m") == 0, a).when(F.col("m") == 1, b).otherwise(d)
    return o.select(
        F.col("k").alias("doc_id"),
        by_kind(F.lit("invoice"), F.lit("receipt"), F.lit("purchase_order")).alias("gold_type"),
        s.alias("gold_supplier"),
        F.to_date("d").alias("gold_date"),
        F.col("p").alias("gold_total"),
        by_kind(invoice, receipt, order).alias("text"),
    )


def flawed(docs: DataFrame) -> DataFrame:
    """Rendered documents with flaw (0 to 5, by doc_id): none; no date, amount, supplier or number; a date that checks refuse."""
    text = F.col("text")
    cuts = {
        1: r"(?m)^(?:Invoice Date|Date|PO Creation Date) ?: .*\n",
        2: r"\n(?:Balance Due: |TOTAL AMT PAYABLE |Grand Total ).*",
        3: r"(?m)^(?:Vendor|Company Name|SUPPLIER): .*\n",
        4: r"(?m)^(?:Receipt No\. |PO Number : ).*\n|(?<=INVOICE) # \d+",
    }
    flaw = F.floor(F.col("doc_id") / 3) % 6
    changed = F.regexp_replace(F.regexp_replace(text, r"(\d{4})-(\d\d)-(\d\d)", "$1/$2/$3"), r"(\d\d)[/.](\d\d)[/.](\d{4})", "$1-$2-$3")
    made = F.when(F.col("flaw") == 5, changed)
    for i, pattern in cuts.items():
        made = made.when(F.col("flaw") == i, F.regexp_replace(text, pattern, ""))
    return docs.withColumn("flaw", flaw).withColumn("text", made.otherwise(text))


#: The same for DuckDB, as a common table expression named corpus.
SQL = """sup as (select l_orderkey, min(l_suppkey) sk from lineitem group by l_orderkey),
o as (select o_orderkey k, o_orderkey % 3 m, o_totalprice p, o_orderdate d, c_name c,
        case when sk is null then 'Unknown Trading Company'
             else concat(chr(cast(65 + sk % 26 as int)), chr(cast(65 + cast(floor(sk/26) as int) % 26 as int)),
                         chr(cast(65 + cast(floor(sk/676) as int) % 26 as int)), ' Trading Company') end s
      from orders join customer on o_custkey = c_custkey left join sup on o_orderkey = l_orderkey),
corpus as (select k doc_id, case m when 0 then 'invoice' when 1 then 'receipt' else 'purchase_order' end gold_type, s gold_supplier,
  cast(d as date) gold_date, p gold_total,
  case m
  when 0 then concat('INVOICE # ', cast(k+10000 as varchar), chr(10), 'Vendor: ', s, chr(10), 'Bill To: ', c, chr(10),
                     'Invoice Date: ', strftime(d,'%Y-%m-%d'), chr(10), 'Balance Due: $', format('{:,.2f}',p))
  when 1 then concat('Company Name: ', s, chr(10), 'RECEIPT', chr(10), 'Receipt No. R', cast(k+10000 as varchar), chr(10),
                     'Date: ', strftime(d,'%d/%m/%Y'), chr(10), 'TOTAL AMT PAYABLE Rs. ', format('{:,.2f}',p), chr(10), 'Payment mode: Card')
  else concat('PURCHASE ORDER', chr(10), 'PO Number : ', cast(k+5380000000 as varchar), chr(10),
              'PO Creation Date : ', strftime(d,'%d.%m.%Y'), chr(10), 'SUPPLIER: ', s, chr(10), 'Grand Total ', format('{:,.2f}',p)) end text
from o)"""


def varied(docs: DataFrame) -> DataFrame:
    """Rendered documents (doc_id, gold_*) in eight wordings a type: form (0 to 7, by doc_id) and text.

    Numbers, dates, amounts and suppliers stand behind other labels or none, before their labels, beside smaller amounts and in noise.
    """
    n, big = (F.col("doc_id") + 10000).cast("string"), (F.col("doc_id") + 5380000000).cast("string")
    s, amount, day = F.col("gold_supplier"), F.format_number("gold_total", 2), lambda pattern: F.date_format("gold_date", pattern)
    iso, dmy, dot, short, long = day("yyyy-MM-dd"), day("dd/MM/yyyy"), day("dd.MM.yyyy"), day("MMM d, yyyy"), day("d MMMM yyyy")
    far = "all goods were checked and packed with care and left our store in order on time\n"
    digits = "".join(f"{i} {i}\n" for i in range(10, 24))
    lines = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    invoices = [
        lines("Invoice No INV-", n, "\nVendor: ", s, "\nInvoice Date: ", iso, "\nTotal: 1.00\n", far, "Grand Total: $", amount),
        lines("Invoice Number: ", n, "\nBill From: ", s, "\nDate: ", short, "\nAmount Due: LKR ", amount),
        lines("TAX INVOICE\nINV ", n, "\nFrom: ", s, "\nIssued Date: ", long, "\nNet Total ", amount),
        lines("INVOICE # ", n, " ", s, " Bill To: Someone\nInvoice Date: ", dmy, "\nBalance Due: $", amount),
        lines(s, "\nINVOICE # ", n, "\nBill To: Someone\n", iso, "\nBalance Due: Rs. ", amount),
        lines("INVOICE # ", n, "\nVendor: ", s, "\nInvoice Date: ", iso, "\nUnit Price Total 9,999,999.00\n", far, far, "Balance Due: $", amount),
        lines("INVOICE # ", n, "\nVendor: ", s, "\nInvoice Date: ", dot, "\n$", amount, "\nBalance Due\nTotal"),
        lines("Vendor: ", s, " 20260001\nInvoice No: ", n, "\nInvoice Date: 45/45/2020\nDate: ", iso, "\nTotal Amount: RM", amount),
    ]
    receipts = [
        lines("Company Name: ", s, "\nReceipt # R", n, "\nDate: ", dmy, "\nTOTAL\n$", amount, "\nCASH TENDERED\n$9,999,999.00\n", far, "CHANGE\n$30.00"),
        lines("SALES RECEIPT\n", s, "\nReceipt Number: R", n, "\n", iso, "\nCash Total ", amount),
        lines("Company Name: ", s, "\nReceipt No.\nDate: ", iso, "\nTX-2026-", n, "\nAmount Paid Rs. ", amount),
        lines("RECEIPT\n", digits, s, "\nReceipt No. R", n, "\nDate: ", dot, "\nNET TOTAL ", amount),
        lines("Vendor: ", s, "\nReceipt No. R", n, "\nDate: ", dmy, "\nBalance Paid\n", far, far, "lkr ", amount, "\n", far, "lkr 1.00"),
        lines("Company Name: ", s, "\nRECEIPT\nReceipt No. R", n, "\nDate: ", dmy, "\nGrand Total 9,999,999.00 Cashier: 2\n", far, far, "Amount Payable: ", amount),
        lines("Company Name: ", s, " Fax 0112\nReceipt #R", n, "\n", short, "\nTOTAL AMT INCL. GST ", amount),
        lines("Company Name: ", s, "\nRECEIPT\nInvoice No: ", n, "\nDate: ", dmy, "\nTOTAL AMOUNT ", amount),
    ]
    orders = [
        lines("PURCHASE ORDER\nP.O. No : ", big, "\nOrder Date: ", dmy, "\nSUPPLIER: ", s, "\nSub Total 1.00\nOrder Total: ", amount),
        lines("PURCHASE ORDER\nOrder Number: ", n, "\nOrder Date: ", iso, "\nVendor: ", s, "\nTotal Value ", amount),
        lines("Purchase Order # ", n, "\nDate: ", short, "\nSupplier Name: ", s, "\nGrand Total ", amount),
        lines("PURCHASE ORDER\nour PO # ", n, "\nLast Modified 01/01/2001\n", dmy, "\nSUPPLIER: ", s, "\nNet Total ", amount),
        lines("PURCHASE ORDER\nour ref PO", n, "\nOrder Date: ", long, "\nSUPPLIER: ", s, "\nTotal Amount Rs. ", amount),
        lines("PURCHASE ORDER\nORIGINAL\n", big, "\n", dot, "\nPO Number :\nPO Creation Date :\nSUPPLIER: ", s, "-1007037\nGrand Total ", amount),
        lines("PURCHASE ORDER\nPO Number : ", big, "\nOrder Date: ", dmy, "\nTo: ", s, ", Tel 0112\nGrand Total ", amount),
        lines("PURCHASE ORDER\nPO Number : ", big, "\nPO Creation Date : ", dot, "\nSupplier 1007 ", s, " Address Main Road\nGrand Total ", amount),
    ]
    form = F.pmod(F.floor(F.col("doc_id") / 3), F.lit(8)).cast("int")
    pick = lambda texts: F.get(F.array(*texts), form)
    text = F.when(F.col("gold_type") == "invoice", pick(invoices)).when(F.col("gold_type") == "receipt", pick(receipts)).otherwise(pick(orders))
    return docs.select("doc_id", form.alias("form"), text.alias("text"))


#: The fields that varied() shows, for DuckDB; corpus as above.
VARIED = """v as (select *, (doc_id // 3) % 8 f, cast(doc_id + 10000 as varchar) n, cast(doc_id + 5380000000 as varchar) big, format('{:,.2f}', gold_total) a,
  strftime(gold_date, '%Y-%m-%d') iso, strftime(gold_date, '%d/%m/%Y') dmy, strftime(gold_date, '%d.%m.%Y') dot, strftime(gold_date, '%b %-d, %Y') short, strftime(gold_date, '%-d %B %Y') long from corpus)
select doc_id, cast(f as integer) form, gold_type as type,
  case gold_type when 'invoice' then case f when 0 then 'INV-' || n when 2 then 'INV ' || n else n end
    when 'receipt' then case f when 2 then 'TX-2026-' || n when 7 then n else 'R' || n end
    else case when f in (0, 5, 6, 7) then big when f = 4 then 'PO' || n else n end end as invoice_number,
  case gold_type when 'invoice' then [iso, short, long, dmy, iso, iso, dot, iso][f + 1] when 'receipt' then [dmy, iso, iso, dot, dmy, dmy, short, dmy][f + 1]
    else [dmy, iso, short, dmy, long, dot, dmy, dot][f + 1] end as date,
  case gold_type when 'invoice' then ['$', 'LKR ', '', '$', 'Rs. ', '$', '$', 'RM'][f + 1] when 'receipt' then ['$', '', 'Rs. ', '', 'lkr ', '', '', ''][f + 1]
    else case f when 4 then 'Rs. ' else '' end end || a as amount, gold_supplier as supplier from v"""
