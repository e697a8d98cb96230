"""Marked sentences for measuring the mention model: written by hand, apart from the labelled table, before the model was trained on it.

No form, name or number of them is made by the rules of lodestone/llm/labelled.py. STAFF lists some of their persons, as staff lists do.
"""

from __future__ import annotations

STAFF = {"given": ["Daniel", "Olivia", "Henrik", "Chidi", "Marguerite", "Yusuf", "Bill", "Rose"], "family": ["Kim", "Bergström", "Whitcombe", "Adeyemi", "Lindqvist", "Fontaine", "Okafor"]}

MARKED = """Good morning, this is [person_name|Olivia Whitcombe] from the front desk.
[person_name|Michael] called twice about the broken heater.
She works for [person_name|Daniel Kim] on the third floor.
Professor [person_name|David Okafor] will give the lecture on Tuesday.
Please forward the invoice to [email|accounts.payable@harborview-clinic.org] before noon.
You can text me at [phone|07911 123456] any time after six.
The White House stands at [street_address|1600 Pennsylvania Avenue NW, Washington, DC 20500].
My new number is [phone|(415) 555-0132], the old one no longer works.
His social security number, [identity_number|219-09-9999], was printed on the card.
The parcel was left at [street_address|42 Wallaby Way, Sydney] with a neighbour.
Patient: [person_name|Henrik Bergström], seen on 12 March 2021, returned for a check on 4 April.
I spoke with Mrs. [person_name|Adeyemi] about the school trip, and she agreed.
If you have questions, ask [person_name|Chidi] or [person_name|Rose].
Write to us: [email|info (at) lakeside-books (dot) com].
Her passport, number [identity_number|C03005988], expires next year.
Call the plumber on [phone|+44 161 496 0753] if the leak gets worse.
He moved from [street_address|17 Bramble Close, Leeds LS6 3QP] to [street_address|5B Harbour Terrace].
Signed, [person_name|M. Fontaine]
Best regards,
[person_name|Marguerite Fontaine]
Head of Purchasing
[phone|+33 6 12 34 56 78]
The winner is [person_name|Yusuf Demir], who lives in Ankara.
[person_name|Lindqvist, Astrid] was absent on Friday.
Our office is at [street_address|221 Baker Street, Suite 300, London].
Mail cheques to [street_address|P.O. Box 7710, Tulsa, OK 74105].
The tenant, Mr [person_name|Whitcombe], has not paid since June.
Insurance number [identity_number|QQ 12 34 56 C] belongs to the claimant.
I got a mail from [email|t.nakamura+newsletter@mail.example.co.jp] this morning.
Der Antrag von [person_name|Sabine Hoffmann] liegt seit Montag vor.
Bitte rufen Sie uns unter [phone|+49 89 1234 5678] an.
Unsere Adresse lautet [street_address|Lindenstraße 12, 10969 Berlin].
Meine Steuernummer ist [identity_number|12 345 678 901].
Madame [person_name|Claire Moreau] habite au [street_address|8 rue de la Paix, 75002 Paris].
Vous pouvez écrire à [email|claire.moreau@exemple.fr] ou appeler le [phone|01 42 68 53 00].
El señor [person_name|Javier Ortega] vive en [street_address|Calle Mayor 15, 28013 Madrid].
Mi DNI es [identity_number|12345678Z] y mi teléfono es [phone|612 345 678].
The driver [person_name|Tom Becker] handed the keys to [person_name|Ana Silva].
Contact [person_name|j. okafor] or send a note to [email|j.okafor@uni.example.edu].
Emergency contact: [person_name|Priya Raman], [phone|555-867-5309].
Ship it to [person_name|Bill Henderson], [street_address|980 Maple Drive, Apt 4C, Denver, CO 80203].
As [person_name|Grace Liu] wrote yesterday, the meeting starts at ten.
Tax ID: [identity_number|94 271 636 508]. Phone: [phone|(0)20 7946 0018].
My brother [person_name|Samuel] lost his driving licence.
The nurse, [person_name|Ingrid Solberg], noted the temperature twice.
The report was checked by [person_name|Peter Novak] and [person_name|Lucía Fernández].
Ask for [person_name|Karen] at the counter.
Reach the duty officer at [phone|1-800-555-0199 ext. 24].
[person_name|Emily Carter] <[email|emily.carter@northwind.example]> wrote:
To: [email|board@riverside-school.org]
Send the form to jane dot doe? No: [email|jane.roe at riverbank dot net].
Invoice for [person_name|Ahmed Hassan], [street_address|73 King's Road, Brighton BN1 2FA].
The card was issued to [person_name|MARIA GONZALEZ].
[person_name|Okafor] signed the lease last week.
Dear [person_name|Nadia],
thank you for the flowers.
Hi [person_name|Leo], can you bring the projector?
The landlord is [person_name|Robert O'Brien]; his number is [phone|0161 555 0187].
SSN: [identity_number|078-05-1120]
Passport No: [identity_number|X4RTBPFW4]
The house at [street_address|14 Rue Lepic] has a blue door.
Visit us at [street_address|2100 Sunset Blvd, Los Angeles].
Fax [phone|+1 212 555 0100], attention [person_name|Helen Zhou].
A student named [person_name|Oleksandr Kovalenko] asked a good question.
[person_name|Bill] paid the bill.
[person_name|Rose Tyler] picked a rose.
Thanks, [person_name|Ben]
Name: [person_name|Fatima Zahra]
Address: [street_address|9 Orchard Lane, Bath]
Mobile: [phone|07700 900461]
E-mail: [email|fatima_z@post.example]
The meeting starts at 10:30 in room 204.
The population grew from 1,204,000 to 1,310,500 between 2001 and 2011.
Version 10.4.2 fixes 31 bugs and adds the option --dry-run.
The Golden Gate Bridge was opened in 1937.
Order 4471-2290 was shipped on 2023-11-02 and weighs 3.5 kg.
Flight LH 441 leaves Houston at 16:05 and lands in Frankfurt at 08:40.
The file lies at /var/data/2021/export_0042.csv and has 88213 rows.
Annual Report and Financial Review are the two chapters.
Turn left after the second traffic light and walk 300 metres.
The server at 10.0.12.7 answered with error 503 after 30 s.
Please use the hashtag #cleanup or mention @teamblue.
The street was closed, and the bridge too.
Bill the client at the end of the month.
In May the river rose by 40 cm.
Chapter 12 covers the years 1914 to 1918.
The hash is 9f86d081884c7d659a2feaa0c55ad015 and the key length 256.
It costs 49.90 EUR, or 54.20 USD with shipping.
Mix 200 g of flour with 3 eggs and 100 ml of milk.
Das Museum öffnet um 9 Uhr und schließt um 18 Uhr.
Le train de 14 h 05 arrive à Lyon à 16 h 01.
El partido terminó 3 a 1 y empezó a las 20:45.
Silver Lake and Red Hill are popular for walks.
ISBN 978-3-16-148410-0 is out of print.
The number 000-12-3456 is no valid number.
Rack B7 holds 24 disks of 18 TB.
The April issue comes out late.""".split("\n")

#: A second set, written after the last training and measured once.
LATER = """Dr. [person_name|Amelia Okonjo] moved her clinic to [street_address|310 Willow Creek Road, Suite 12, Boise, ID 83702].
Ring [person_name|Kenji Morita] on [phone|+81 3 5555 0142] before the flight.
The refund goes to [email|yara.haddad@cedarbank.example], not to the branch.
My mother, [person_name|Ingeborg Thalmann], was born in 1941 in Graz.
Please send the keys to [street_address|Flat 3, 58 Canal Street, Manchester M1 3WD].
I lost my passport ([identity_number|P4718266]) on the train to Prague.
For the tax office: [identity_number|47 036 892 816].
[person_name|Lukas] forgot his jacket; could [person_name|Hannah] bring it?
Herr [person_name|Dietmar Vogelsang] wohnt seit 2009 in der [street_address|Gartenstraße 77, 79098 Freiburg].
La réunion avec [person_name|Hélène Garnier] est fixée à 9 h.
Contactez-nous : [email|service.clients@boutique.example] ou [phone|04 72 00 11 22].
La abogada [person_name|Marta Ibáñez] tiene su despacho en la [street_address|Avenida de América 31, 28002 Madrid].
Customer [person_name|Noor Rahman] called from [phone|020 7946 0991] and gave the number [identity_number|AB 65 43 21 C].
[person_name|S. Whitaker] and [person_name|R. J. Donnelly] countersigned.
If nobody answers, try [phone|555-0170] or [phone|(312) 555-0119 x 41].
Her SSN is [identity_number|536-22-8145] and her address [street_address|77 Massachusetts Avenue, Cambridge, MA 02139].
Mail: [email|o.brandt [at] werkstatt [dot] example]
[person_name|Priscilla Adeleke] teaches chemistry; her assistant is [person_name|Wei Zhang].
The plaintiff, [person_name|George Papadakis], lives at [street_address|12 Rue des Acacias, 69003 Lyon].
Return to sender: [person_name|Tess Holloway], [street_address|PO Box 318, Fargo, ND 58107].
The lake is 14 km long and 310 m deep.
Page 212 of the Blue Guide describes the Old Town Hall.
Invoice 2024-0093 is due on 15 June; pay 1,240.00 EUR.
Bring 2 forks, 3 knives and 12 plates to room 7.
Mount Elbert lies in Colorado, Ben Nevis in Scotland.
Der Bus 42 fährt ab 6.15 Uhr alle 20 Minuten zum Bahnhof.""".split("\n")
LATER_STAFF = {"given": ["Amelia", "Lukas", "Noor", "Tess"], "family": ["Vogelsang", "Garnier", "Donnelly", "Zhang"]}

#: A third set, written while the model was trained for the last time, after the second had been read, and measured once.
LAST = """[person_name|Ruth Abernathy] restored the organ in four months.
I met [person_name|Tomasz Wrona] and [person_name|Elin Sandberg] at the fair.
You will find our shop at [street_address|205 Orchard Street, Unit 9, Burlington, VT 05401].
Her extension is new: [phone|(802) 555-0146 ext. 88].
Please mail [email|frida-berg@nordlicht.example] the drawings by Friday.
Taxpayer number: [identity_number|83 402 117 955].
The guard wrote down passport [identity_number|N9K27X415] and let us in.
[person_name|Oskar], your bicycle is in the hall.
Der Hausmeister heißt [person_name|Manfred Köhler], Telefon [phone|0761 555 018].
Madame [person_name|Lefort] attend au [street_address|5 bis avenue du Parc, 35000 Rennes].
Escriba al taller o llame a [person_name|Inés Prieto].
Mr [person_name|Osei] lives at [street_address|Flat 12, 9 Mill Road, Cambridge CB1 2AZ].
The nurse called [person_name|Gwendolyn Frost] twice on [phone|+44 7700 900 318].
Her social security number, [identity_number|301-45-7729], is on page two.
[person_name|BAKARE, FOLASADE] passed the exam.
Yesterday [person_name|Nils] and [person_name|Petra] cleaned the cellar.
The train to Lindau leaves platform 4 at 17:52.
Use 250 ml of water and 40 g of sugar for 6 people.
Chapter 9, Harbour Lights, begins on page 188.
Serial number 7730019245 belongs to the old pump.
Am Samstag fallen 12 Züge zwischen Ulm und Augsburg aus.
In June the council raised the rents by 4 percent.""".split("\n")
LAST_STAFF = {"given": ["Ruth", "Oskar", "Nils"], "family": ["Sandberg", "Osei", "Köhler"]}
