"""A small set of extracts as files, with one fault of each kind."""

from __future__ import annotations

import json
from pathlib import Path

CRM = """Account ID,Company,Sector,Town,Primary Contact Email,Account Manager,Customer Since,Seats
C-0001,"Acme, Ltd",RETAIL,Leeds,ann@acme.example,Mia Hall,03/02/2019,12
C-0002,Bolt "B" & Co,health care,York,bob@bolt.example,Mia Hall,1/12/2020,40
C-0003,Cog plc,Energy,Hull,cat@cog.example,Raj Shah,15/06/2021,7
""".replace('Bolt "B" & Co', '"Bolt ""B"" & Co"')

BILLING = """invoice_no,cust_ref,product_line,net_amount,issued,paid_on
I1,CUST0001,Broadband,"£1,204.00",2024-01-01,
I2,CUST0001,Backup,£300.50,2024-04-01,2024-04-20
I3,CUST0002,Broadband,£99.99,2024-04-01,
I4,CUST0002,Broadband,"£1,2O4.00",2024-04-01,2024-04-30
I5,CUST0999,Broadband,£10.00,2024-04-01,
I6,oops,Broadband,£x,2024-13-01,
"""

TICKETS = [
    # Opened and resolved within 61 seconds of P1's 4 hours: boundaries count, not elapsed time.
    (1, 1, "P1", "2024-04-01T00:00:59", "2024-04-01T04:01:00", 2),
    (2, 1, "P1", "2024-04-01T00:00:00", "2024-04-01T04:00:59", None),
    (3, "1", "P9", "2024-04-02T00:00:00", "2024-05-02T00:00:00", 5),
    (4, 2, "P4", "2024-03-01T00:00:00", None, None),
    (5, 2, "P4", "2023-01-01T00:00:00", "2023-02-01T00:00:00", 1),
    (6, "unknown", "P2", "2024-04-01T00:00:00", None, 3),
]

USAGE = """acct,period,voice_minutes,data_gb,outage_minutes
NB/0001,2023-01,10,100.0,500
NB/0001,2024-01,11,150.0,7
NB/0001,2024-02,12,100,5
NB/0001,2024-03,13,130.0,20
NB/0001,2024-04,14,130.0,
NB/0003,2024-04,n/a,1.5,9
"""


def write_extracts(folder: Path) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "crm_accounts.csv").write_text(CRM, encoding="utf-8")
    (folder / "billing_invoices.csv").write_text(BILLING, encoding="utf-8")
    (folder / "network_usage.csv").write_text(USAGE, encoding="utf-8")
    names = ("ticket_id", "client", "priority", "opened_at", "resolved_at", "csat")
    tickets = [dict(zip(names, t)) | {"category": "Email", "summary": "call ann"} for t in TICKETS]
    (folder / "servicedesk_tickets.json").write_text(json.dumps(tickets, indent=1), encoding="utf-8")
    return str(folder)
