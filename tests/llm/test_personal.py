"""Spans that the trees add, on sentences written by hand: {{kind|span}} marks what is personal."""

import re

from undula.llm import personal

SENTENCES = """
You can reach me at {{email|jane.doe (at) example (dot) org}} after lunch.
My address is {{email|s.miller [at] mailhost [dot] com}}, please write soon.
Questions go to {{email|support(at)widgets(dot)io}} during office hours.
Send your CV to {{email|jobs at northwind dot com}} before Friday.
Kontakt: {{email|info [at] beispiel.de}} oder per Brief.
Email: {{email|peter_k @ provider . net}} if the form is broken.
We met at noon. Dinner was served at eight.
Look at page.Then close the book and go home.
The shop at Corner Street is open at weekends.
He works at Google.Com was the old name of nothing.
She is good at chess and bad at cards.
Write to {{email|maria.lopez (at) correo (dot) es}} for the Spanish edition.
The server {{ip|192[.]168[.]10[.]4}} stopped answering last night.
Blocked traffic from {{ip|203(.)0(.)113(.)77}} and its neighbours.
Observed beacon to {{ip|45[dot]33[dot]32[dot]156}} at midnight.
Section 300[.]400[.]500[.]600 of the manual is missing.
Version 999[.]1[.]2[.]3 does not exist.
My visa is {{card|4111.1111.1111.1111}} and expires in May.
Paid with card {{card|5500-0000-0000-0004}} last week.
Order 4111 1111 1111 1112 has been shipped.
Serial number 1234567812345678 is on the back.
Tracking id 9400110200881234567890 was delivered.
Call me on {{phone|(702) 555-0142}} tonight.
My phone is {{phone|702-555-0199}}, leave a message.
Tel. {{phone|030 1234 5678}} oder Fax.
Reach the desk at {{phone|0044 20 7946 0958}} any time.
Mobile: {{phone|415.555.0137}} works best.
Text me at {{phone|212 555 0188}} when you land.
The date was 2023-10-17 and it rained.
On 12.04.2019 the treaty was signed.
ISBN 978-3-16-148410-0 is out of print.
Invoice 4432 221 87 is still open.
The score was 21-19 and 21-17 in the end.
Between 1914-1918 the town was empty.
Fax {{phone|(030) 901820}} is switched off at night.
Ring {{phone|0171 555 01 23}} and ask for the manager.
Population grew from 120 450 to 130 900 people.
Coordinates 52.5200 13.4050 point to the capital.
It costs 1.299.000 euros, taxes included.
Please mail {{email|anna @ example.com}} a copy.
Mail to {{email|tom.b (at) uni-muenster.de}} works as well.
He stared at the wall . net result was zero.
Lunch is at 12 dot on the clock.
Meet us @ the bar . It opens late.
Part 0800 1234 is out of stock.
Ticket 555-01-22 was closed.
"""


def test_added_spans_are_mostly_right_and_found(spark):
    rows, marked = [], {}
    for i, line in enumerate(SENTENCES.strip().splitlines()):
        text, spans, at = "", set(), 0
        for m in re.finditer(r"\{\{(\w+)\|(.*?)\}\}", line):
            text += line[at : m.start()]
            spans.add((m[1], len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        rows.append((i, text + line[at:]))
        marked[i] = spans
    found = wanted = right = 0
    for row in personal.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        named = lambda some: {(personal.KINDS[s.rank], s.start, s.end) for s in some}
        base = named(row.base)
        added, due = named(row.spans) - base, marked[row.doc_id] - base
        found, wanted, right = found + len(added), wanted + len(due), right + len(added & due)
    assert wanted == 21 and right >= 0.85 * wanted and right >= 0.85 * found


def test_candidates_of_different_generators_overlap(spark):
    text = "reach me at jane.doe (at) example (dot) org today"
    row = personal.find_personal(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(personal.spans_text("spans").alias("s")).first()
    at = text.index("jane")
    assert row.s == f"email:{at}:{at + len('jane.doe (at) example (dot) org')}"
