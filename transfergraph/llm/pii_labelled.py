"""Sentences with marked personal data from which the field of operator 11 is trained: {kind:text} marks a span."""

LABELLED = """
Call me on {phone:(030) 901820-17} after six.
Please ring {phone:0171 5557713} or write a letter.
You can reach the office at {phone:555-123-4567} during the day.
My number is {phone:+1 (212) 555-0187} and I am in all week.
Tel: {phone:0049 30 901820}
tel. {phone:030/901820}
Phone {phone:(415) 555-2671}, fax on request.
Telefon {phone:0221 47110815} oder im Laden fragen.
Rufen Sie {phone:+49 221 4711081} an.
Mein Handy ist {phone:0151-23456789}.
Erreichbar unter {phone:089 636-48018} bis zum Abend.
Appelez le {phone:01 42 68 53 00} avant midi.
Mon portable est le {phone:06 12 34 56 78}.
Téléphone: {phone:+33 1 42 68 53 00}
Joindre le bureau au {phone:04-72-10-30-30} le matin.
Llame al {phone:91 411 22 33} por la tarde.
Mi teléfono es {phone:612 345 678} y vivo en Madrid.
Móvil {phone:+34 612 345 678}.
Llámame al {phone:612-345-678} cuando puedas.
whatsapp {phone:+44 7700 900123} any time
She left {phone:020 7946 0958} on the pad.
the number {phone:555.867.5309} was on the wall
mobile {phone:07700 900 456}
Ring {phone:(0161) 496-0345}. Then wait.
fax {phone:1-800-555-0199}
and the hotline {phone:1 800 555 0123} was busy
in the end {phone:+1 (503) 555-7713} was of no use to the man
lines of noise & {phone:+1 (017) 555-1290}&&& then more
Write to {email:jane.doe@example.com} today.
Mail {email:j_smith42@mail.example.org}, please.
Contact: {email:support@example.net}
of the word {email:j.34@mail7.example.com} of the text
My address is {email:jane dot doe at example dot com} for now.
Send it to {email:bob at example dot org}.
Mail {email:mary (at) example (dot) com} with the form.
write {email:info [at] example [dot] net} for help
Contact {email:sales(at)example.com} soon
{email:peter[at]example.org} has the key
Reach {email:anna @ example.com} by noon.
Send mail to {email:kim at mail dot example dot com} and wait.
E-Mail {email:hans.meier(at)example.de} genügt.
Schreiben Sie an {email:max punkt muster at example punkt de} bitte.
Schreib {email:lena [at] example [punkt] de} an.
Kontakt {email:verlag @ example.de}
Écrivez à {email:luc (arobase) example (point) fr} demain.
Courriel: {email:marie.curie[at]example.fr}
Envoyez tout à {email:paul arobase example point fr} svp
Escriba a {email:luis arroba example punto es} hoy.
Correo {email:ana.gil(arroba)example.es} del centro.
Mande un correo a {email:pepe [arroba] example [punto] com} mañana.
Connect to {ip:10.0.0.17} over the tunnel.
The host {ip:192.168.1.254} went down.
seen from {ip:203.0.113.9} at night
Login from {ip:198[.]51[.]100[.]23} failed.
blocked {ip:203[.]0[.]113[.]77} and others
traffic to {ip:10(.)1(.)2(.)3} was cut
client {ip:192 . 168 . 0 . 12} again
server {ip:172 dot 16 dot 254 dot 1} answered
Der Rechner {ip:10.20.30.40} ist aus.
Adresse {ip:192[.]0[.]2[.]66} gesperrt
L'hôte {ip:203.0.113.200} ne répond pas.
La máquina {ip:172.31.0.9} no responde.
ping {ip:2001:db8::1} works
route to {ip:fe80::1ff:fe23:4567:890a} is up
from {ip:2001:db8:85a3::8a2e:370:7334} came nothing
My card is {card:4111 1111 1111 1111} and works.
Charge {card:5500-0000-0000-0004} please.
Card number {card:4012888888881881}.
Amex {card:3782 822463 10005} on file
paid with {card:378282246310005} last week
use {card:3714 496353 98431} instead
card {card:4111.1111.1111.1111} was declined
the card {card:6011/0009/9013/9424} is lost
Visa {card:4222222222222} is old
Diners {card:3056 930902 5904} expired
Diners card {card:38520000023237} is there
Karte {card:4111 1111 1111 1111} gesperrt.
Die Karte {card:3782 822463 10005} gilt noch.
Kreditkarte {card:5555.5555.5555.4444}
Carte {card:4012 8888 8888 1881} perdue
La carte {card:3714 496353 98431} est bloquée.
Tarjeta {card:5105 1051 0510 5100} robada
Mi tarjeta es {card:3530.1113.3330.0000} y no va.
The year 1984 was long, and 2001 longer.
On 12-05-2019 the shop closed.
It was 2020-03-14 15:09:26 by the clock.
Am 24.12.1999 fiel Schnee.
Le 14/07/1789 on fit la fête.
El 12.10.1492 llegaron tres naves.
Version 1.2.3 came after 1.1.
Release 10.15.7 of the tool is out.
Section 3.2.1 covers the rest.
The price is 1,299.00 or 1.299,00 in all.
It costs $ 45.50 for 3 of them.
Only 37 % of 12000 people came.
Order 20394857 was sent.
invoice no. 2019-000451 of the firm
part 8845-221-B fits
ISBN 978-3-16-148410-0 is the book.
ISBN 3-598-21508-8 too
token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" is set
token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" &&& of
the key 9c8b45435718dcc700c184a7e303cdc64c6a8f7f was lost
id 550e8400-e29b-41d4-a716-446655440000 is a name
hash 5d41402abc4b2a76b9719d911017c592
number 1234567890123456 is no card
the serial 9807915762804490 of it
4952935900253051 of the things
we saw 239040950064896 stars
7844238401328226 and so on
and 1000000 more, then 250 000 in all
He ran 42.195 km in 2:03:59 hours.
See page 12, lines 3-17, and note 4.
Room 101, floor 3, gate 7.
GET /index.html 200 1043
width 1920x1080 at 60 Hz
https://example.com/a/b?c=1 is a page
see www.example.org for more
Copyright (c) 2004-2021 the authors.
MIT License, version 2.0, all rights
# of 4 ### and %%% or *** in $$$
a | b | c | 12 | 13 | 14.5
The man at the dot of noon was at home.
We met at noon, at the point of the pier.
He looked at the point and at the man.
Der Punkt an der Wand war rot.
Le point est là, au bord.
El punto y la línea.
The cat sat on the mat, and it was good.
Ereser thaningnt thtiontion. Anatha, of the in
In nicht ü einachie. Ungheiten und der für ich.
Ue óciónas ñas, lojaadoñ para el que de la
Que ouchque le treré, des les aux en de la
THE WHOLE LINE IS LOUD!! AND SO IS THIS!! HERE!!
the@ of@ and @ are marks
a.b.c and x.y are paths in code
f(x) = 3 * (y - 2) + 17
int main(void) { return 0; }
[1] [2] and [17] cite the work
(1) first, (2) second, (30) last
at 10.30 or 11.45 the train goes
10:00:00 to 11:30:00 is the slot
dial the number and wait for the tone
the mail at the door was wet
the card in the drawer was blank
""".strip().split("\n")
