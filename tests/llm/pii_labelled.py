"""Sentences written and labelled by hand, for personal data that the base patterns don't take: (sentence, what is personal in
it). Base spans that stand in them are not listed."""

LABELLED = [
    ("You can call the office at (030) 123-4567 before noon.", ["(030) 123-4567"]),
    ("Our receptionist, 555-867-5309, will know.", ["555-867-5309"]),
    ("Ring 0171 555 0192 and ask for Mary.", ["0171 555 0192"]),
    ("From abroad dial 0044 20 7946 0958 instead.", ["0044 20 7946 0958"]),
    ("Appelez le 06 12 34 56 78 le soir.", ["06 12 34 56 78"]),
    ("Erreichbar unter 089/1234567 oder per Post.", ["089/1234567"]),
    ("Text me on 07700 900123 when you land", ["07700 900123"]),
    ("Her desk: 1-800-555-0199, extension three.", ["1-800-555-0199"]),
    ("tel: 212.555.0147", ["212.555.0147"]),
    ("(020) 7946 0018 is the number of the clinic", ["(020) 7946 0018"]),
    ("My landline (040 555123) no longer works; take 040-5551234.", ["040-5551234", "040 555123"]),
    ("please fax it to 01632 960983", ["01632 960983"]),
    ("Write to jane dot doe at example dot com if in doubt.", ["doe at example dot com"]),
    ("bob (at) mail (dot) example (dot) org", ["bob (at) mail (dot) example (dot) org"]),
    ("he signs as kim[at]lab[dot]net on the list", ["kim[at]lab[dot]net"]),
    ("maria AT posta DOT it was her address then", ["maria AT posta DOT it"]),
    ("Pay into DE89 3704 0044 0532 0130 00 by Friday.", ["DE89 3704 0044 0532 0130 00"]),
    ("IBAN GB29NWBK60161331926819 (main account)", ["GB29NWBK60161331926819"]),
    ("the refund went to FR1420041010050500013M02606", ["FR1420041010050500013M02606"]),
    ("NL91ABNA0417164300 belongs to the club.", ["NL91ABNA0417164300"]),
    ("his card, 4111.1111.1111.1111, was declined", ["4111.1111.1111.1111"]),
    ("charge 5500/0000/0000/0004 please", ["5500/0000/0000/0004"]),
    ("SSN 123-45-6789 was on the form", ["123-45-6789"]),
    ("my social security number: 321-54-9876", ["321-54-9876"]),
    ("Call (415) 555-2671 or (415) 555-2672.", ["(415) 555-2671", "(415) 555-2672"]),
    ("Mobil 0151 23456789, Büro 030 901820", ["0151 23456789", "030 901820"]),
    ("The doctor's private line is 604-555-0134.", ["604-555-0134"]),
    ("leave a message on 020 8366 1177", ["020 8366 1177"]),
    ("contact: 00 33 1 42 68 53 00", ["00 33 1 42 68 53 00"]),
    ("It happened on 2024-05-06 10:22:33 in the yard.", []),
    ("The meeting is on 2024-05-06.", []),
    ("call me after 2024-05-06 10:22", []),
    ("phone booked from 10:00-12:30 on 06.05.2024", []),
    ("Updated 05/06/2024 11:15 by the editor", []),
    ("log 20240506-102233 was rotated", []),
    ("[2023-11-02 08:15:59.123] service started", []),
    ("He lived 1914-1918 at the front and 1920 - 1955 at home.", []),
    ("see pp. 123-145 and pp. 1002-1019", []),
    ("ISBN 978-3-16-148410-0 is out of print", []),
    ("my copy (ISBN 9780306406157) got lost", []),
    ("Invoice 2024-00123 is due, invoice 2024-00124 is not.", []),
    ("order number 100200300400", []),
    ("ticket #4455667788 was closed", []),
    ("Version 1.22.333.4444 fixes that", []),
    ("upgrade from 10.0.19041.1052 to 10.0.22621.963", []),
    ("pi is 3.14159265 and e is 2.71828182", []),
    ("The valley lies at 52.5200 13.4050, roughly.", []),
    ("A total of 1 234 567.89 was raised; 12.345.678 in the end.", []),
    ("The population grew from 1 204 500 to 1 310 220.", []),
    ("scores of 100:98, 87:85 and 110:102", []),
    ("Das Urteil vom 12.03.1998 (Az. 5 U 1234/97)", []),
    ("part no. A1234567 fits, part no. B7654321 doesn't", []),
    ("US patent 5,123,456 and patent 6123456", []),
    ("her train leaves at 18:45:00 sharp", []),
    ("between 1999-2003 we moved four times", []),
    ("commit 1234567 broke build 20231102.4", []),
    ("card 4111.1111.1111.1112 is no card", []),
    ("the sequence 1 1 2 3 5 8 13 21 34 55", []),
    ("dial settings 12-34-56 for the safe", []),
    ("Temperatures of 21.5 22.7 23.1 19.8 were recorded", []),
    ("flight LH1234567 does not exist", []),
    ("chapter 12.4.5.6.7 of the norm", []),
    ("npm i lodash@4.17.21 and react@18.2.0", []),
    ("the figures 123456 789012 are made up", []),
    ("call at 9:30-10:15 or 14:00-15:45", []),
    ("mail dated 1.12.2023 10:05 was lost", []),
    ("Meet me at noon at the station dot", []),
    ("an account of the years 1848/1849", []),
    ("phones sold: 120 000 000 in 2023", []),
    ("my phone died on 31/12/2022 at 23:59", []),
    ("serial KQ123-4567-89", []),
    ("resolution 1920x1080, 2560x1440 and 3840-2160", []),
    ("DE00 0000 0000 0000 0000 00 is not valid", []),
    ("build 2023.11.02.1500 passed", []),
]
