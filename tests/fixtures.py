"""Messy documents written for the tests."""

PEOPLE = (
    "Email,Start Date,City,Name,Salary,Age\n"
    "nora@harbor.test,2019-11-30,Turku,Nora Dahl,61200,52\n"
    "pim@harbor.test,Feb 2020,TKU,Pim Oost,48150.75,\n"
    "lea@harbor,04/09/2018,Gent,Lea Wouters,$1,050,000,37\n"
    ",2021/12/01,GNT,Ari Salo,57000,44\n"
    "ruth@harbor.test,13-2021,Turku,Ruth Aalto,a lot,n/a\n"
    "sol@harbor.test,09-Sep-2022, Gent,,$43,500,29\n"
    "ivo@harbor.test,,Turku,Ivo Maas,50000, 61"
)
ALIASES = {"TKU": "Turku", "GNT": "Gent"}

LOG = "\n".join(
    [
        "[2031-11-20 17:30:00.500] WARN  disk nearly full volume=v3",
        "[2031-11-20 17:30:04.000] INFO  PUT /shelf/4 200 31ms reader=r9",
        '[2031-11-20 17:31:10.000] ERROR GET /shelf/77 404 6ms err="unknown shelf" reader=r2',
        "[2031-11-20 17:32:00.000] WARN  valve shut by operator",
        '[2031-11-20 17:32:30.250] ERROR POST /fees/payments 502 88ms err="bank: closed" user_id=r2 amount=3.75',
        "[2031-11-20 17:33:45.000] INFO  valve open again",
        "[2031-11-20 17:34:00.000] INFO  DELETE /shelf/4 204 9ms",
    ]
)

INVOICE = """INVOICE #INV-77

Date: 2030-02-11
Due:  2030-03-01
PO#:  B-77

From: Saltmarsh Printing
      Mill Row 8
      Lund, 22100
      Tax ID: 55-120

To:   Reed and Sons
      Quay 3
      Attn: Edda Reed

Description                Qty      Unit Price   Amount
-------------------------------------------------------
Poster (large)             40       $1.25        $50.00
Cloth Binding              12.5 m   $4.00/m      $50.00
Proof Sheet                1        $0.00        FREE
-------------------------------------------------------
                                    Subtotal:   $100.00
                                    Tax (20%):   $20.00
                                    TOTAL:      $120.00

Wire to: Skerry Savings, Acct# 5501, Routing# 8812
"""

TICKETS = """From: ann@shop.test
Date: 2031-05-02 9:15 PM
Subject: Printer on fire
Priority: High

Smoke is coming out of tray two.
Please hurry.

Status: Open
---
From: ben@shop.test
Subject: New chair
Priority: Low

No rush at all.
"""

STATEMENT = (
    "Account statement\nHolder: Ann\nPeriod: May\n\n"
    "Date\tDescription\tDebit\tCredit\tBalance\n"
    "05/01\tCoffee\t$4.50\t\t$95.50\n05/02\tSalary\t\t$900.00\t$995.50\n05/03\tRent\t$700.00\t\t$295.50\n"
)

XML = (
    '<?xml version="1.0"?><shop><item id="a1"><name>Cup</name><price>4.5</price></item>'
    '<item id="a2"><name>Pot</name><price>12</price></item></shop>'
)

NESTED = (
    '{"status":"ok","meta":{"page":1,"empty":""},"data":{"org":"X","units":[{"name":"A","head":{"id":1}},'
    '{"name":"B","head":null}],"tags":["p","q","r"]}}'
)
