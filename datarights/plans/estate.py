"""A code estate derived from the supplier table: one repository per supplier.

What a repository's account closure does depends on its key, what its tables and buckets are
called and how long it keeps things on its nation. The text is built by Spark expressions, so
the estate grows with the table and every expected answer has a closed form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datarights.operators.resolve import Code, resolve
from datarights.operators.verdicts import Estate, build_estate, verdicts
from datarights.plans.registry import read
from datarights.session import stage
from datarights.sources import corpus as co
from datarights.sources.facts import extract_facts
from datarights.sources.rules import rules

SHAPES = 13
#: on_delete token of the child table per shape, CASCADE where not named
TOKENS = {1: "SET_NULL", 2: "PROTECT", 3: "PROTECT", 4: "PROTECT"}

MODELS = """from django.db import models


class User(models.Model):
    email = models.EmailField()
    phone = models.CharField(max_length=20)


class Parcel{n}(models.Model):
    owner = models.ForeignKey(User, on_delete=models.{token})
    notes = models.TextField()
"""
CONFIG = """BUCKET = "avatars-{n}"
"""
SERVICES = """import logging
import boto3
import redis
import stripe
from app.config import BUCKET

logger = logging.getLogger("audit")
client = redis.Redis()
s3 = boto3.client("s3")


def avatar_key(user_id):
    return "x"


def remember(user):
    client.set(f"session:{{user.id}}", user.email)
    s3.put_object(Bucket=BUCKET, Key=avatar_key(user.id))
    stripe.Customer.create(email=user.email)
    logger.info("seen", user.email)


def drop_session(pk):
    client.delete(f"session:{{pk}}")


def drop_files(pk):
    s3.delete_object(Bucket=BUCKET, Key=avatar_key(pk))
"""
BACKUP = """DUMP_COLUMNS = ["email", "phone"]
{keep}

def dump_all():
    return DUMP_COLUMNS
"""
HELPERS = """from app.models import User


def drop_rows(pk):
    user = User(pk=pk)
    user.delete()
"""
TASKS = """from datetime import timedelta
from celery import shared_task
from app.models import User


@shared_task
def purge_users():
    stale = User(seen=timedelta(days={days}))
    stale.delete()
"""
SETTINGS = """CELERY_BEAT_SCHEDULE = {{"nightly": {{"task": "app.tasks.purge_users"}}}}
"""
TERRAFORM = """resource "aws_s3_bucket_versioning" "avatars" {{
  bucket = "avatars-{n}"
  versioning_configuration {{
    status = "{status}"
  }}
}}
"""
HEAD = """import hashlib
from app.models import Parcel{n}, User
from app.services import drop_files, drop_session
from web import app, audited


"""
ROUTE = """@app.route("/users/<pk>", methods=["DELETE"])
"""
VIEWS = {
    0: ROUTE + "def delete_user(request, pk):\n    user = User(pk=pk)\n    user.delete()\n",
    3: ROUTE + "def delete_user(request, pk):\n    user = User(pk=pk)\n    Parcel{n}.objects.filter(owner=user).delete()\n    user.delete()\n",
    4: ROUTE + "def delete_user(request, pk):\n    user = User(pk=pk)\n    Parcel{n}.objects.filter(owner=user, status=\"draft\").delete()\n    user.delete()\n",
    5: "def deactivate_account(request, pk):\n    user = User(pk=pk)\n    user.is_active = False\n    user.save()\n",
    7: "def anonymize_user(request, pk):\n    user = User(pk=pk)\n    user.email = \"removed\"\n    user.phone = None\n    user.save()\n",
    8: "def forget_me(request, pk):\n    user = User(pk=pk)\n    user.email = hashlib.sha256(user.email)\n    user.save()\n",
    9: "def cleanup_rows(request, pk):\n    user = User(pk=pk)\n    user.delete()\n",
    10: "def close_account(request, service, pk):\n    service.drop_rows(pk)\n",
    11: ROUTE + "def delete_user(request, pk):\n    user = User(pk=pk)\n    user.delete()\n    drop_session(pk)\n    drop_files(pk)\n",
    12: "@audited\n" + ROUTE + "def delete_user(request, pk):\n    user = User(pk=pk)\n    user.delete()\n",
}
VIEWS[1] = VIEWS[2] = VIEWS[0]
VIEWS[6] = VIEWS[5]


def _fill(template: str, **cells):
    """A template as a Column: literal pieces and the given columns, braces unescaped."""
    pieces, rest = [], template
    for name in sorted(cells, key=lambda c: -len(c)):
        rest = rest.replace("{" + name + "}", "\x00" + name + "\x00")
    for i, piece in enumerate(rest.split("\x00")):
        if i % 2:
            pieces.append(cells[piece].cast("string"))
        elif piece:
            pieces.append(F.lit(piece.replace("{{", "{").replace("}}", "}")))
    return F.concat(*pieces)


def source_files(spark: SparkSession, sf: str) -> DataFrame:
    """repo_id, path, text of every file of the estate, skipped ones included."""
    s = read(spark, sf, "supplier").select(F.concat(F.lit("repo"), F.col("s_suppkey").cast("string")).alias("repo_id"),
                                           (F.col("s_suppkey") % SHAPES).cast("int").alias("k"), F.col("s_nationkey").alias("n"))
    n, k = F.col("n"), F.col("k")
    token = F.coalesce(*[F.when(k == i, F.lit(v)) for i, v in TOKENS.items()], F.lit("CASCADE"))
    body = F.coalesce(*[F.when(k == i, _fill(HEAD + v, n=n)) for i, v in sorted(VIEWS.items())])
    keep = F.when(n % 2 == 0, F.concat(F.lit("RETENTION_DAYS = "), (n + 30).cast("string"))).otherwise("")
    status = F.when(n % 2 == 1, "Enabled").otherwise("Suspended")
    pairs = [("app/models.py", _fill(MODELS, n=n, token=token)), ("app/config.py", _fill(CONFIG, n=n)), ("app/services.py", _fill(SERVICES)),
             ("app/backup_job.py", _fill(BACKUP, keep=keep)), ("app/views.py", body), ("infra/main.tf", _fill(TERRAFORM, n=n, status=status)),
             ("app/tests/models.py", _fill(MODELS, n=n + 100, token=token)), ("app/helpers.py", F.when(k == 10, F.lit(HELPERS))),
             ("app/tasks.py", F.when(k == 6, _fill(TASKS, days=n + 10))), ("settings.py", F.when(k == 6, _fill(SETTINGS))),
             ("app/broken.py", F.when(k == 9, F.lit("def x(:\n")))]
    files = s.select("repo_id", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), text.alias("text")) for p, text in pairs])).alias("f"))
    return files.select("repo_id", "f.path", "f.text").where("text IS NOT NULL")


_MEMO: dict[tuple, object] = {}


def _once(spark: SparkSession, sf: str, what: str, make):
    """Stage tables of one session are written once and shared by the queries over them."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _MEMO:
        _MEMO[key] = make()
    return _MEMO[key]


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    files = source_files(spark, sf).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    return co.classify_paths(files)


def python_files(spark: SparkSession, sf: str) -> DataFrame:
    return scanned(spark, sf).where("skip_reason IS NULL AND path LIKE '%.py'").select("repo_id", "path", "text")


def facts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return _once(spark, sf, "facts", lambda: extract_facts(stage(python_files(spark, sf))))


def code(spark: SparkSession, sf: str) -> Code:
    return _once(spark, sf, "code", lambda: resolve(facts(spark, sf), stage(python_files(spark, sf))))


def declarations(spark: SparkSession, sf: str) -> DataFrame:
    """Versioning declarations over the config files and the sources as text."""
    r = rules()
    v = r.map("versioning")
    config = co.scan_config(source_files(spark, sf).withColumn("n_bytes", F.octet_length("text"))).select("repo_id", "path", "text")
    return co.versioning(config.unionByName(python_files(spark, sf)), ["repo_id", "path"], r.words("versioning_literals"), v["qualifier"], int(v["window"]))


def estate(spark: SparkSession, sf: str) -> Estate:
    return _once(spark, sf, "estate", lambda: build_estate(code(spark, sf), declarations(spark, sf)))


def decided(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return _once(spark, sf, "verdicts", lambda: verdicts(estate(spark, sf)))
