"""Fifteen small conversion cases of our own, three a kind: used by the tests and the benchmark."""

from __future__ import annotations

import json
import os
from typing import NamedTuple

from tabshift.operators.transforms import Entity
from tabshift.plans.convert import Spec


class Sample(NamedTuple):
    use_case: str
    case: str
    input_format: str
    output_format: str
    text: str
    expected: str
    spec: Spec
    required: tuple[str, ...] = ()


_USER = Entity("user", "user_", key=True)
_SAMPLES = [
    Sample("nest", "simple_01", "csv", "json", "user_name,user_mail,order_id,order_price\nAda,ada@x.org,1,25.00\nBo,bo@x.org,2,9.5\n",
           json.dumps([{"user": {"name": "Ada", "mail": "ada@x.org"}, "orders": [{"id": 1, "price": 25.0}]}, {"user": {"name": "Bo", "mail": "bo@x.org"}, "orders": [{"id": 2, "price": 9.5}]}]),
           Spec("nest", (Entity("user", "user_"), Entity("orders", "order_", "array")))),
    Sample("nest", "simple_02", "csv", "json", "item_name,item_sku,kind_code\nPen,007,a\nInk,008,b\n",
           json.dumps([{"item": {"name": "Pen", "sku": "007"}, "kind": {"code": "a"}}, {"item": {"name": "Ink", "sku": "008"}, "kind": {"code": "b"}}]),
           Spec("nest", (Entity("item", "item_"), Entity("kind", "kind_")))),
    Sample("nest", "medium_01", "csv", "json", "user_name,order_id,order_price\nZoe,5,1.5\nAda,6,2.5\nZoe,7,3.5\n",
           json.dumps([{"user": {"name": "Zoe"}, "orders": [{"id": 5, "price": 1.5}, {"id": 7, "price": 3.5}]}, {"user": {"name": "Ada"}, "orders": [{"id": 6, "price": 2.5}]}]),
           Spec("nest", (_USER, Entity("orders", "order_", "array")))),
    Sample("flatten", "simple_01", "json", "csv", '[{"name": "Ada", "home": {"zip": "00501", "city": "Holt"}}, {"name": "Bo, Jr", "home": {"zip": "10001", "city": "Rye"}}]',
           'name,home.zip,home.city\nAda,00501,Holt\n"Bo, Jr",10001,Rye\n', Spec("flatten")),
    Sample("flatten", "simple_02", "json", "csv", '[{"n": "x", "s": {"ram": 8, "cpu": "i"}}]', "n,s.ram,s.cpu\nx,8,i\n", Spec("flatten")),
    Sample("flatten", "medium_01", "json", "csv", '[{"c": "x", "now": {"t": 3, "h": 40, "wind": {"v": 7, "dir": "N"}}}, {"c": "y", "now": {"t": 4, "h": 41, "wind": {"v": 8, "dir": "S"}}}]',
           "c,now.t,now.h,now.wind.v,now.wind.dir\nx,3,40,7,N\ny,4,41,8,S\n", Spec("flatten")),
    Sample("log", "simple_01", "txt", "csv", "[2026-01-02 03:04:05] INFO db: up: yes\n[2026-01-02 03:04:06] WARN web.in: slow\n",
           "timestamp,level,source,message\n2026-01-02T03:04:05,INFO,db,up: yes\n2026-01-02T03:04:06,WARN,web.in,slow\n", Spec("log")),
    Sample("log", "simple_02", "txt", "csv", "2026-01-02T03:04:05Z ERROR [auth] no, never\n", 'timestamp,level,source,message\n2026-01-02T03:04:05,ERROR,auth,"no, never"\n', Spec("log")),
    Sample("log", "medium_01", "txt", "csv", "2026-01-02 03:04:05,678 INFO  [main] a.B - hi\nnot a log line\n", "timestamp,level,source,message\n2026-01-02T03:04:05,INFO,a.B,hi\n,,,not a log line\n", Spec("log")),
    Sample("report", "simple_01", "csv", "txt", "region,sales,units\nNorth,100,3\nSouth,250,4\n", "", Spec("report", title="Sales", sums={"Total sales": "sales", "Total units": "units"}), ("North", "Total sales: 350", "Total units: 7")),
    Sample("report", "simple_02", "csv", "txt", "who,math\nAda,90\nBo,81\n", "", Spec("report", title="Marks", means={"Mean math": "math"}), ("Ada", "Mean math: 85.50")),
    Sample("report", "medium_01", "csv", "txt", "id,qty,price,kind\na,12,8.35,E\nb,7,41.05,E\nc,2,1.50,H\n", "", Spec("report", title="Stock", product=("kind", "qty", "price")), ("E: 387.55", "H: 3.00", "Grand total: 390.55")),
    Sample("migrate", "simple_01", "json", "json", '[{"user_name": "Ada", "user_age": 36}]', '[{"name": "Ada", "age": 36}]', Spec("rename_json", names={"user_name": "name", "user_age": "age"}, order=("name", "age"))),
    Sample("migrate", "simple_02", "csv", "csv", "userName,userAge,userCity\nAda,36,Holt\n", "name,city,age\nAda,Holt,36\n", Spec("rename_csv", names={"userName": "name", "userAge": "age", "userCity": "city"}, order=("name", "city", "age"))),
    Sample("migrate", "medium_01", "json", "json", '{"results": [{"firstName": "Ada", "lastName": "L", "mail": "a@x", "birthYear": 1815}]}', '{"users": [{"name": {"first": "Ada", "last": "L"}, "contact": {"email": "a@x"}, "birth_year": 1815}]}',
           Spec("restructure", root="results", new_root="users", target={"name": {"first": "firstName", "last": "lastName"}, "contact": {"email": "mail"}, "birth_year": "birthYear"})),
]
SAMPLES = {f"{s.use_case}/{s.case}": s for s in _SAMPLES}


def write(root: str) -> None:
    """The cases as directories root/use_case/case with meta.json, input.* and expected.*."""
    for s in SAMPLES.values():
        folder = f"{root}/{s.use_case}/{s.case}"
        os.makedirs(folder, exist_ok=True)
        meta = {"use_case": s.use_case, "complexity": s.case.split("_")[0], "input_format": s.input_format, "output_format": s.output_format, "required_substrings": list(s.required) or None}
        for name, text in (("meta.json", json.dumps(meta)), (f"input.{s.input_format}", s.text), (f"expected.{s.output_format}", s.expected or "see required_substrings\n")):
            with open(f"{folder}/{name}", "w", encoding="utf-8", newline="") as f:
                f.write(text)
