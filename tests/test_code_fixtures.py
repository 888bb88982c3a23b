"""Small repositories, one per behaviour, resolved and decided in one job.

Each scenario is a repository id with its files; the expectations below it are read off the
framework semantics the rules stand for.
"""

import textwrap

import pytest

from conftest import rows
from datarights.operators.resolve import references, resolve, unmodelled
from datarights.operators.verdicts import build_estate, explain, verdicts
from datarights.sources.facts import extract_facts
from datarights.sources.rules import rules

REPOS: dict[str, dict[str, str]] = {}


def repo(name, **files):
    REPOS[name] = {path.replace("__", "/") + ".py": textwrap.dedent(text) for path, text in files.items()}


USER = """
from django.db import models
class User(models.Model):
    email = models.EmailField()
"""
DELETE = """
from app.models import User
def delete_user(pk):
    user = User(pk=pk)
    user.delete()
"""

repo("calls", a="""
from b import helper as h, Thing
import b
import os
from . import missing
class Base:
    def run(self): pass
class Child(Base):
    def go(self):
        self.run(); super().run(); self.absent()
        h(); local(); b.helper(); Thing.make(); Thing.objects.make(); os.remove('x'); unknown.solo(); twice(); nothing(); (lambda: local())()
        getattr(self, 'x')
    @classmethod
    def build(cls): cls.go()
class Ext(os.PathLike):
    def f(self): self.gone()
def local(): pass
def shadow():
    from c import other as h
    h()
if True:
    def redefined(): pass
else:
    def redefined(): pass
def use(): redefined(); apply(local)
""", b="""
def helper(): pass
def solo(): pass
def twice(): pass
class Thing:
    def make(self): pass
""", c="""
def other(): pass
def twice(): pass
""", d="""
from c import *
def starred(): solo()
""")

repo("receiver", app__models=USER + """
class Avatar(models.Model):
    user = models.ForeignKey(User, on_delete=models.CASCADE)
    image = models.FileField(upload_to="x")
""", app__views=DELETE, app__signals="""
from django.db.models.signals import post_delete
from django.dispatch import receiver
from app.models import Avatar
@receiver(post_delete, sender=Avatar)
def clean(sender, instance, **kw):
    instance.image.delete(save=False)
""", app__apps="""
class Config:
    def ready(self):
        import app.signals
""", settings="INSTALLED_APPS = ['app']\n")
REPOS["receiver_any"] = {k: v.replace("sender=Avatar", "weak=True").replace("(sender, instance, **kw)", "(source, instance, **kw)") for k, v in REPOS["receiver"].items()}
REPOS["receiver_unloaded"] = {k: v for k, v in REPOS["receiver"].items() if k != "app/apps.py"}
REPOS["receiver_db_cascade"] = {k: v.replace("models.CASCADE", "models.DB_CASCADE") for k, v in REPOS["receiver"].items()}
REPOS["receiver_other_sender"] = {k: v.replace("sender=Avatar", "sender=User").replace("import Avatar", "import User") for k, v in REPOS["receiver"].items()}
REPOS["cleanup_all"] = {**REPOS["receiver_unloaded"], "app/signals.py": "", "settings.py": "INSTALLED_APPS = ['app', 'django_cleanup']\n"}
REPOS["cleanup_split"] = {**REPOS["cleanup_all"], "settings2.py": "INSTALLED_APPS = ['app']\n"}

repo("orm", app__models="""
from sqlalchemy import Column, ForeignKey, Table
from sqlalchemy.orm import declarative_base, relationship
Base = declarative_base()
tags = Table("user_tags", Base.metadata, Column("tag_id"))
class User(Base):
    __tablename__ = "users"
    id = Column(primary_key=True)
    email = Column()
    posts = relationship("Post", cascade="all, delete-orphan")
    logs = relationship("Log", cascade="save-update")
    labels = relationship("Label", secondary=tags)
class Post(Base):
    __tablename__ = "posts"
    user_id = Column(ForeignKey("users.id"))
class Log(Base):
    __tablename__ = "logs"
    user_id = Column(ForeignKey("users.id"))
class Label(Base):
    __tablename__ = "labels"
    text = Column()
class Note(Base):
    __tablename__ = "notes"
    user_id = Column(ForeignKey("users.id", ondelete="CASCADE"))
""", app__views="""
from app.models import User
def delete_user(session, pk):
    user = User(pk)
    session.delete(user)
""", app__db="""
from sqlalchemy import create_engine
engine = create_engine("sqlite:///app.db")
""")
REPOS["orm_server"] = {**REPOS["orm"], "app/db.py": REPOS["orm"]["app/db.py"].replace("sqlite:///app.db", "postgresql://h/d")}
REPOS["orm_pragma"] = {**REPOS["orm"], "app/db.py": REPOS["orm"]["app/db.py"] + textwrap.dedent("""
    from sqlalchemy import event
    @event.listens_for(engine, "connect")
    def on(conn, record):
        conn.execute("PRAGMA foreign_keys=ON")
    """)}

repo("override", app__models=USER + """
    photo = models.ImageField()
    def delete(self, *a):
        self.photo.delete()
""", app__views=DELETE)
REPOS["override_queryset"] = {**REPOS["override"], "app/views.py": "from app.models import User\ndef delete_user(pk):\n    User.objects.filter(pk=pk).delete()\n"}
REPOS["wrapped"] = {**REPOS["override"], "app/views.py": textwrap.dedent("""
    from app.models import User
    from web import audited
    @audited
    def delete_user(pk):
        user = User(pk=pk)
        user.delete()
    """)}
REPOS["wrapped_bypass"] = {**REPOS["wrapped"], "app/more.py": REPOS["override"]["app/views.py"].replace("delete_user", "remove_account")}
repo("raw_sql", app__models=USER + """
class Post(models.Model):
    user = models.ForeignKey(User, on_delete=models.CASCADE)
""", app__views="""
def delete_user(cursor, pk):
    cursor.execute("DELETE FROM users WHERE id = %s", pk)
""")
repo("related", app__models=USER + """
class Post(models.Model):
    user = models.ForeignKey(User, on_delete=models.SET_NULL, related_name="posts")
""", app__views="""
from app.models import User
def delete_user(pk):
    user = User(pk=pk)
    user.posts.all().delete()
""")
repo("unscheduled", app__models=USER, app__tasks="""
from celery import shared_task
from app.models import User
@shared_task
def purge_users():
    stale = User(1)
    stale.delete()
""")
repo("admin", app__models=USER, app__admin="""
from django.contrib import admin
from app.models import User
class UserAdmin(admin.ModelAdmin):
    def has_delete_permission(self, request, obj=None):
        if obj:
            return True
        return False
admin.site.register(User, UserAdmin)
""")
REPOS["admin_denied"] = {**REPOS["admin"], "app/admin.py": REPOS["admin"]["app/admin.py"].replace("        if obj:\n            return True\n", "")}
repo("entries", app__models=USER, app__views="""
from rest_framework.viewsets import ModelViewSet
from django.views.generic import DeleteView
from app.models import User
class UserViewSet(ModelViewSet):
    queryset = User.objects.all()
    def destroy(self, request): pass
class AccountDeleteView(DeleteView):
    def form_valid(self, form): pass
def gone(request): pass
@router.delete("/posts/{post_id}")
def delete_post(post_id): pass
@router.delete("/me")
def drop(me): pass
@click.command("wipe-users")
def wipe_all(): pass
def cleanup(): pass
def outer():
    def purge_user(): pass
""", app__urls="""
from django.urls import path
from app.views import gone
urlpatterns = [path("account/close_account/", gone)]
""", app__management__commands__purge_users="""
from django.core.management.base import BaseCommand
class Command(BaseCommand):
    def handle(self): pass
""")
repo("services", app__work="""
import analytics
import sentry_sdk
from celery import Celery
from elasticsearch import Elasticsearch
from app.conf import INDEX
es = Elasticsearch()
sentry_sdk.init("dsn")
app = Celery()
def seen(user):
    es.index(index=INDEX, document={"email": user.email})
    analytics.identify(user.id, {"email": user.email})
    mailer.delay(user.email, queue="mails")
    pinger.delay(user.id, queue="pings")
def close_account(pk):
    es.delete(index=INDEX, id=pk)
    analytics.create_regulation(regulation_type="SUPPRESS_WITH_DELETE")
""", app__conf='INDEX = "people"\n')
REPOS["services_variable"] = {**REPOS["services"], "app/work.py": REPOS["services"]["app/work.py"].replace('"SUPPRESS_WITH_DELETE"', "KIND") + 'KIND = "SUPPRESS_WITH_DELETE"\n'}
repo("reference", app__models=USER, app__views="""
from app.models import User
def remover(pk):
    user = User(pk=pk)
    user.delete()
def close_account(queue, pk):
    queue.push(remover, pk)
""")
repo("declared", app__models=USER, app__views="""
from app.models import User
def blank(pk):
    user = User(pk=pk)
    user.delete()
""")
repo("opaque", app__cache="""
import redis
r = redis.Redis()
def put(user): r.set(f"sess:{user.id}", user.email)
def close_account(name): getattr(r, name)()
""")
repo("two_kinds", app__models="""
from django.db import models
class Session(models.Model):
    email = models.EmailField()
""", app__cache="""
import redis
r = redis.Redis()
def put(user): r.set(f"session:{user.id}", user.email)
""")


@pytest.fixture(scope="module")
def built(spark):
    data = [(name, path, text) for name, files in REPOS.items() for path, text in files.items()]
    files = spark.createDataFrame(data, "repo_id string, path string, text string")
    code = resolve(extract_facts(files), files)
    none = spark.createDataFrame([], "repo_id string, file string, line int, literal string")
    estate = build_estate(code, none)
    return code, estate, verdicts(estate)


def of(df, name):
    return df.where(df.repo_id == name)


def test_call_resolution(built):
    code = built[0]
    calls = {(r.caller.split(".")[-1], r.dotted): (r.outcome, r.rule, r.target, r.n_candidates) for r in of(code.calls, "calls").collect()}
    want = {
        ("go", "self.run"): ("resolved", "CG-8", "a.Base.run"), ("go", "super().run"): ("resolved", "CG-10", "a.Base.run"),
        ("go", "self.absent"): ("unresolved", "CG-8", None), ("f", "self.gone"): ("ambiguous", "CG-8", None), ("build", "cls.go"): ("resolved", "CG-9", "a.Child.go"),
        ("go", "h"): ("resolved", "CG-1", "b.helper"), ("shadow", "h"): ("resolved", "CG-1", "c.other"), ("go", "local"): ("resolved", "CG-2", "a.local"),
        ("go", "b.helper"): ("resolved", "CG-6", "b.helper"), ("go", "Thing.make"): ("resolved", "CG-6", "b.Thing.make"),
        ("go", "Thing.objects.make"): ("ambiguous", "CG-11", "b.Thing.make"), ("go", "os.remove"): ("unresolved", "CG-7", None),
        ("go", "unknown.solo"): ("ambiguous", "CG-11", "b.solo"), ("go", "twice"): ("ambiguous", "CG-4", None), ("go", "nothing"): ("unresolved", "CG-5", None),
        ("go", "getattr"): ("unresolved", "CG-12", None), ("starred", "solo"): ("resolved", "CG-20", "b.solo"), ("use", "redefined"): ("ambiguous", "CG-2", "a.redefined")}
    assert {k: calls[k][:3] for k in want} == want
    assert calls[("go", "twice")][3] == 2
    assert rows(of(references(code), "calls"), "caller", "target") == [("a.use", "a.local")]
    assert rows(of(unmodelled(code.symbols, rules()), "calls"), "symbol") == []


def verdict_map(built, name):
    return {r.store_id: (r.verdict, r.rule) for r in of(built[2]["stores"], name).collect()}


def test_receivers_and_cleanup(built):
    assert verdict_map(built, "receiver")["avatar.image"] == ("erased", "row 4")
    assert verdict_map(built, "receiver")["avatar"] == ("erased", "row 4")
    for name in ("receiver_unloaded", "receiver_db_cascade", "receiver_other_sender"):
        got = verdict_map(built, name)
        assert got["avatar"][0] == "erased", name
        assert got["avatar.image"][0] == "not_erased", name
    assert verdict_map(built, "cleanup_all")["avatar.image"] == ("erased", "row 4")
    assert verdict_map(built, "cleanup_split")["avatar.image"] == ("unverified", "R10")


def test_receiver_of_all_tables(built):
    edges = rows(of(built[1].edges, "receiver_any").where("kind = 'SE2'"), "src", "dst")
    assert edges == [("signal:any", "app.signals.clean"), ("store:avatar", "signal:any"), ("store:user", "signal:any")]


def test_unmodelled_decorators(built):
    assert verdict_map(built, "wrapped")["user"] == ("unverified", "R27")
    assert verdict_map(built, "wrapped_bypass")["user"] == ("erased", "row 4")


def test_orm_cascades(built):
    got = verdict_map(built, "orm")
    assert {k: v[0] for k, v in got.items()} == {"users": "erased", "posts": "erased", "user_tags": "erased", "logs": "not_erased", "labels": "not_erased", "notes": "unverified"}
    assert got["notes"][1] == "R6"
    assert verdict_map(built, "orm_server")["notes"][0] == "erased"
    assert verdict_map(built, "orm_pragma")["notes"][0] == "erased"
    rel = rows(of(built[1].relations, "orm"), "parent", "child", "kind", "token", "ondelete")
    assert ("users", "user_tags", "secondary", "tags", "") in rel and ("users", "notes", "fk", "", "CASCADE") in rel


def test_deletion_shapes(built):
    assert verdict_map(built, "override")["user.photo"][0] == "erased"
    assert verdict_map(built, "override_queryset")["user.photo"] == ("unverified", "R26 ambiguous")
    raw = verdict_map(built, "raw_sql")
    assert raw["user"][0] == "erased" and raw["post"] == ("unverified", "R19")
    related = verdict_map(built, "related")
    assert related["post"][0] == "erased" and related["user"][0] == "not_erased"
    assert verdict_map(built, "unscheduled")["user"][0] == "not_erased"
    assert verdict_map(built, "reference")["user"] == ("unverified", "R26 reference")
    assert verdict_map(built, "opaque")["sess"] == ("unverified", "R26 opaque call")


def test_entry_points(built):
    got = rows(of(built[1].entries, "entries"), "name", "kind")
    assert got == sorted([("destroy", "route"), ("form_valid", "view"), ("gone", "view"), ("drop", "route"), ("wipe_all", "cli"), ("purge_users", "cli")])
    assert rows(of(built[1].entries, "admin"), "name", "sets_mode") == [("admin_delete_model", "model_delete"), ("admin_delete_selected", "queryset_delete")]
    assert rows(of(built[1].entries, "admin_denied"), "name") == []
    assert verdict_map(built, "admin")["user"][0] == "erased" and verdict_map(built, "admin_denied")["user"][0] == "no_entry_point"
    assert [r.flags for r in of(built[1].entries, "unscheduled").collect()] == [["task_decorator", "unscheduled"]]


def test_services(built):
    stores = {(r.store_id, r.kind) for r in of(built[1].stores, "services").collect()}
    assert stores == {("people", "search_index"), ("segment", "third_party"), ("sentry", "third_party"), ("mails", "queue")}
    got = verdict_map(built, "services")
    assert got["people"][0] == "erased" and got["segment"] == ("erased", "R24") and got["sentry"][0] == "external_manual" and got["mails"][0] == "not_erased"
    assert verdict_map(built, "services_variable")["segment"][0] == "external_manual"
    fields = rows(of(built[1].fields, "services").where("store_id = 'sentry'"), "field")
    assert fields == [("query_string",), ("request_body",), ("source_context",), ("stack_locals",), ("url",)]


def test_store_id_of_two_kinds(built):
    got = [(r.store_id, r.kind, ",".join(r.flags)) for r in of(built[1].stores, "two_kinds").collect()]
    assert set(got) == {("session", "relational", "store_id_conflict"), ("session#cache", "cache", "store_id_conflict")}


def test_explain(built):
    told = {(r.repo_id, r.store_id): r.detail for r in explain(built[1], built[2]).collect()}
    assert told[("orm", "logs")].startswith("R5")
    assert told[("receiver_unloaded", "avatar.image")].startswith("R26")  # the receiver has no callers


def test_declared_but_unregistered_start_is_capped(built, spark):
    from datarights.operators.entrypoints import declared_starts, reconcile

    code, estate, _ = built
    told = spark.createDataFrame([("x", "declared", "blank", "app/views.py", 4), ("x", "declared", "ghost", "app/views.py", 4)], "record_id string, repo_id string, name string, file string, line int")
    rows_ = reconcile(told, estate.entries, code.symbols, rules())
    assert rows(rows_, "name", "status") == [("blank", "declared_unregistered"), ("ghost", "unresolved")]
    found = verdicts(estate, extra_starts=declared_starts(rows_, estate.entries))
    assert verdict_map((None, None, found), "declared")["user"] == ("unverified", "declared, not registered")
    assert verdict_map(built, "declared")["user"] == ("no_entry_point", "row 3")
