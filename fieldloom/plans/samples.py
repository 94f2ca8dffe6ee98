"""Small literal tables that the driver's tables have no counterpart of; both engines build them from the same SQL values."""

LABELS = """VALUES (1, 'Full Name / पूरा नाम'), (2, 'Full Name'), (3, 'पूरा नाम'), (4, 'ಹೆಸರು ಹೆಸರು cou EPIC'), (5, 'نام نام'), (6, '12 / 34'), (7, 'Date of of Birth'),
 (8, 'পূর্ণ নাম'), (9, 'పూర్తి పేరు'), (10, 'முழு பெயர்'), (11, 'પૂરું નામ'), (12, 'മുഴുവൻ പേര്'), (13, 'ପୂରା ନାମ'), (14, 'ਪੂਰਾ ਨਾਮ'), (15, ''), (16, NULL), (17, 'जन्म / abc तिथि no')"""
#: kind, value, low, high: answers that stand and answers that don't, by the rule of their kind.
ANSWERS = """VALUES ('mobile_in', '8123 45 6701', NULL, NULL), ('mobile_in', '+91-70010-20030', NULL, NULL), ('mobile_in', '5123456701', NULL, NULL), ('mobile_in', '812345670', NULL, NULL), ('pincode_in', '411045', NULL, NULL), ('pincode_in', '४११०४५', NULL, NULL),
 ('pincode_in', '011045', NULL, NULL), ('aadhaar_in', '3141-5926-5358', NULL, NULL), ('aadhaar_in', '1141 5926 5358', NULL, NULL), ('pan_in', 'qwert 6071 z', NULL, NULL), ('pan_in', 'QWER60712Z', NULL, NULL), ('ifsc_in', 'abcd0x1y2z3', NULL, NULL), ('ifsc_in', 'ABCD1X1Y2Z3', NULL, NULL),
 ('email', 'ina.k@mail.example', NULL, NULL), ('email', 'ina@mail', NULL, NULL), ('email', 'ina k@mail.example', NULL, NULL), ('year', '1987', NULL, NULL), ('year', '87', NULL, NULL), ('blood_group', 'ab -', NULL, NULL), ('blood_group', 'O +', NULL, NULL), ('blood_group', 'C+', NULL, NULL),
 ('date', '7/3/1987', NULL, NULL), ('date', '30.2.1987', NULL, NULL), ('date', '1987-03-07', NULL, NULL), ('date', '7-3-87', NULL, NULL), ('amount', 'Rs. 7,300.25', NULL, NULL), ('amount', '₹12', NULL, NULL), ('amount', '-3', NULL, NULL), ('amount', '1e3', NULL, NULL), ('amount', 'two', NULL, NULL),
 ('integer', '17', 0, 120), ('integer', '121', 0, 120), ('integer', '१७', 18, NULL), ('integer', '1.7', NULL, NULL), ('decimal', '1e3', NULL, NULL), ('decimal', '-1,300.5', NULL, NULL), ('decimal', '100.5', 0, 100), ('decimal', '1_0', 0, 100), ('decimal', 'a', NULL, NULL), ('phone', '020-2553', NULL, NULL), ('phone', '25', NULL, NULL),
 ('bank_account', '0071 2233 44', NULL, NULL), ('bank_account', '712', NULL, NULL), ('person_name', 'Ina Köhler-Rey', NULL, NULL), ('person_name', 'Ina 2', NULL, NULL), ('person_name', '@@##', NULL, NULL), ('alphanumeric', 'K-7/b 2', NULL, NULL), ('alphanumeric', '/-', NULL, NULL), ('alphanumeric', '-', NULL, NULL),
 ('alphanumeric', 'a_b', NULL, NULL), ('signature', '', NULL, NULL), ('choice', '', NULL, NULL), ('office_use', 'x', NULL, NULL), ('attachment', 'x', NULL, NULL), ('text', ' ', NULL, NULL), ('other', 'x', NULL, NULL), ('email', NULL, NULL, NULL)"""
FORMS = [
    (1, "account", "banking", ["account", "nominee", "you"], ["account type", "nominee", "src"]),
    (2, "library", "education", ["library", "genre", "work"], ["reading list", "en"]),
    (3, "travel", "government", ["journey", "and", "visa"], ["visa number", "de"]),
]
MESSAGES = """VALUES ('view', 'en', 'seen'), ('view', 'fr', 'vu'), ('view', 'de', ''), ('click', 'en', 'clicked'), ('click', 'de', 'geklickt'), ('signup', 'fr', 'inscrit'), ('purchase', 'en', 'bought')"""
#: Invented cards; no line of them is a person's.
CARDS = """VALUES (1, concat_ws(chr(10), 'UIDAI', 'Name:  Lotte  Brandvold', 'Date of Birth:', '09-04-1971', 'Female', '3141 5926-5358', 'Address: House 9, Mill Lane', 'Old Quarter', 'Nashik - 422001', 'x')),
 (2, concat_ws(chr(10), 'Income Tax Department', 'Tomas Eklund', 'Father''s Name', 'Per Eklund', 'permanent account number', 'qwert6071z', '11/12/1966')),
 (3, concat_ws(chr(10), 'ELECTION COMMISSION', 'Elector: yes', 'Name', 'Photo:', 'Ruth Okafor', 'S/O: Sam Okafor', 'xyz7654321', 'male 24.12.1980 and 25.12.1980')),
 (4, concat_ws(chr(10), 'plain 31/02/2020', 'son of - Karl Lind', 'Anna Lind', 'address', '12 Hill Road', 'PAN QWERT6071Z', '560001')), (5, NULL), (6, ' | '), (7, concat_ws(chr(10), 'dob 01.01.2000', 'name: 12', 'महिला', 'Unique Identification 9141 5926 5358'))"""
#: entry_id, ord, pos, alias, priority, entry_type of a small dictionary.
ALIASES = """VALUES ('name', 1, 0, 'full name', 1.1, 'text'), ('name', 1, 1, 'name', 1.1, 'text'), ('name', 1, 2, 'पूरा नाम', 1.1, 'text'), ('birth', 2, 0, 'date of birth', 1.1, 'date'), ('birth', 2, 1, 'dob', 1.1, 'date'), ('account', 3, 0, 'bank account number', 1.0, 'text'),
 ('relative', 4, 0, 'brother name', 1.0, 'text'), ('relative', 4, 1, 'name of relative', 1.0, 'text'), ('amount', 5, 0, 'amount', 1.0, 'text'), ('consent', 6, 0, 'i agree to the terms', 1.0, 'checkbox'), ('widget', 7, 0, 'cold widget', 1.0, 'text'), ('widget', 7, 1, 'small widget', 1.0, 'text'), ('gadget', 8, 0, 'gadget', 1.2, 'text'), ('gadget', 8, 1, 'red gadget', 1.2, 'text'), ('bank', 9, 0, 'bank', 1.0, 'text')"""
KEYWORDS = """VALUES ('amount', 0, 'rupees'), ('amount', 1, 'total sum'), ('birth', 0, 'born'), ('widget', 0, 'widget')"""
#: pattern_id, ord, marker, weight.
MARKERS = """VALUES ('name_like', 0, 'name', 0.9), ('number_like', 1, 'number', 1.0), ('number_like', 2, 'no', 1.0), ('date_like', 3, 'date', 1.0), ('date_like', 4, 'date of', 1.0), ('thing_like', 5, 'gizmo', 1.3)"""
WORDINGS = """VALUES ('Full Name', NULL), ('Your Full Name here', 'text'), ('Name', 'checkbox'), ('FULL NAME:', 'date'), ('bank account', 'text'), ('Brother Name', 'text'), ('Mother''s Name', 'text'), ('total sum in rupees', 'text'), ('Born on', 'date'), ('the amount', 'signature'), ('I agree to the terms', 'checkbox'), ('पूरा नाम', NULL), ('', NULL), ('account number of the bank', NULL), ('Date of issue', 'date'), ('Room No', 'text')"""
