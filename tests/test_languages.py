"""Held-out sentences of 40 to 100 characters, and the columns of detect_language."""

from lexatlas.languages import Guesser, plain, profiles
from lexatlas.operators import pages

SENTENCES = {
    "en":["The user agrees that the company may change the price of the product.", "Please read the following rules carefully before ordering anything.", "Old houses often need more repairs than their owners can afford.", "Any dispute arising out of this contract is subject to English law.", "I met him twice last summer while we were living near the sea."],
    "fr":["Le client accepte que la société puisse modifier le prix du produit.", "Veuillez lire attentivement les règles suivantes avant de commander.", "Les vieilles maisons demandent souvent beaucoup de réparations.", "Tout litige relatif au présent contrat est soumis au droit français.", "Je l'ai rencontré deux fois cet été quand nous vivions près de la mer."],
    "de":["Der Kunde stimmt zu, dass die Firma den Preis des Produkts ändern darf.", "Bitte lesen Sie die folgenden Regeln sorgfältig, bevor Sie bestellen.", "Alte Häuser brauchen oft mehr Reparaturen, als ihre Besitzer bezahlen können.", "Für Streitigkeiten aus diesem Vertrag gilt deutsches Recht.", "Ich traf ihn im letzten Sommer zweimal, als wir am Meer wohnten."],
    "es":["El cliente acepta que la empresa pueda modificar el precio del producto.", "Lea atentamente las siguientes reglas antes de hacer un pedido.", "Las casas viejas suelen necesitar más reparaciones de lo que parece.", "Cualquier litigio derivado de este contrato se rige por la ley española.", "Lo encontré dos veces el verano pasado cuando vivíamos cerca del mar."],
    "it":["Il cliente accetta che la società possa modificare il prezzo del prodotto.", "Si prega di leggere con attenzione le seguenti regole prima di ordinare.", "Le vecchie case hanno spesso bisogno di molte riparazioni.", "Qualsiasi controversia relativa al presente contratto è soggetta alla legge italiana.", "L'ho incontrato due volte l'estate scorsa quando vivevamo vicino al mare."],
    "pt":["O cliente aceita que a empresa possa alterar o preço do produto.", "Leia com atenção as seguintes regras antes de fazer um pedido.", "As casas velhas precisam muitas vezes de mais reparações do que parece.", "Qualquer litígio relativo a este contrato é regido pela lei portuguesa.", "Encontrei-o duas vezes no verão passado quando vivíamos perto do mar."],
    "nl":["De klant gaat ermee akkoord dat het bedrijf de prijs van het product wijzigt.", "Lees de volgende regels zorgvuldig door voordat u iets bestelt.", "Oude huizen hebben vaak meer reparaties nodig dan hun eigenaars denken.", "Op geschillen over deze overeenkomst is Nederlands recht van toepassing.", "Ik heb hem vorige zomer twee keer ontmoet toen we bij de zee woonden."],
    "pl":["Klient zgadza się, że firma może zmienić cenę produktu.", "Przed złożeniem zamówienia prosimy uważnie przeczytać poniższe zasady.", "Stare domy często wymagają więcej napraw, niż sądzą właściciele.", "Wszelkie spory wynikające z tej umowy podlegają prawu polskiemu.", "Spotkałem go dwa razy zeszłego lata, kiedy mieszkaliśmy nad morzem."],
    "cs":["Zákazník souhlasí s tím, že společnost může změnit cenu výrobku.", "Před objednáním si prosím pozorně přečtěte následující pravidla.", "Staré domy často potřebují více oprav, než si majitelé myslí.", "Veškeré spory z této smlouvy se řídí českým právem.", "Minulé léto jsem ho potkal dvakrát, když jsme bydleli u moře."],
    "hu":["Az ügyfél elfogadja, hogy a cég megváltoztathatja a termék árát.", "Kérjük, rendelés előtt figyelmesen olvassa el a következő szabályokat.", "A régi házak gyakran több javítást igényelnek, mint gondolnánk.", "A szerződésből eredő jogvitákra a magyar jog az irányadó.", "Tavaly nyáron kétszer találkoztam vele, amikor a tenger közelében laktunk."],
    "ro":["Clientul acceptă ca firma să poată modifica prețul produsului.", "Citiți cu atenție următoarele reguli înainte de a face o comandă.", "Casele vechi au adesea nevoie de mai multe reparații decât pare.", "Orice litigiu privind acest contract este supus legii române.", "L-am întâlnit de două ori vara trecută, când locuiam lângă mare."],
    "tr":["Müşteri, şirketin ürünün fiyatını değiştirebileceğini kabul eder.", "Sipariş vermeden önce lütfen aşağıdaki kuralları dikkatle okuyun.", "Eski evler genellikle sahiplerinin düşündüğünden daha fazla onarım ister.", "Bu sözleşmeden doğan uyuşmazlıklarda Türk hukuku uygulanır.", "Geçen yaz deniz kenarında yaşarken onunla iki kez karşılaştım."],
    "sv":["Kunden godkänner att företaget får ändra priset på produkten.", "Läs följande regler noga innan du beställer något.", "Gamla hus behöver ofta fler reparationer än ägarna tror.", "Tvister som rör detta avtal ska avgöras enligt svensk lag.", "Jag träffade honom två gånger förra sommaren när vi bodde vid havet."],
    "fi":["Asiakas hyväksyy sen, että yritys voi muuttaa tuotteen hintaa.", "Lue seuraavat säännöt huolellisesti ennen tilauksen tekemistä.", "Vanhat talot tarvitsevat usein enemmän korjauksia kuin luullaan.", "Tähän sopimukseen liittyvät riidat ratkaistaan Suomen lain mukaan.", "Tapasin hänet kaksi kertaa viime kesänä, kun asuimme meren lähellä."],
    "vi":["Khách hàng đồng ý rằng công ty có thể thay đổi giá của sản phẩm.", "Vui lòng đọc kỹ các quy tắc sau đây trước khi đặt hàng.", "Những ngôi nhà cũ thường cần sửa chữa nhiều hơn chúng ta nghĩ."],
    "id":["Pelanggan setuju bahwa perusahaan dapat mengubah harga produk.", "Bacalah aturan berikut dengan teliti sebelum memesan sesuatu.", "Rumah tua sering membutuhkan lebih banyak perbaikan daripada yang dikira."],
}


def test_sentences():
    guesser = Guesser()
    lines = [(lang, s) for lang, ss in SENTENCES.items() for s in ss]
    assert all(35 <= len(s) <= 100 for _, s in lines)
    assert sum(guesser.guess(s) == lang for lang, s in lines) >= 0.95 * len(lines)
    for lang in SENTENCES:
        mine = [s for x, s in lines if x == lang]
        assert sum(guesser.guess(s) == lang for s in mine) >= 0.8 * len(mine)


def test_scores_are_sums_over_the_whole_text():
    langs, known, other = profiles({"en": "the cat sat", "xx": "zu zu zo"})
    guesser = Guesser({"en": "the cat sat", "xx": "zu zu zo"}, step=5)
    text = plain("The ZU, cat? 12 \u00e9t\u00e9 zo " * 7)
    want = [0] * len(langs)
    for n, weights in known.items():
        for i in range(len(text) - n + 1):
            want = [a + b for a, b in zip(want, weights.get(text[i : i + n], other[n]), strict=True)]
    assert guesser.scores(text).tolist() == want


def test_columns(spark):
    rows = [(1, None), (2, ""), (3, "123 ..."), (4, "Това е изречение"), (5, "Это предложение ы"), (6, "これは文です"), (7, SENTENCES["it"][0]), (8, SENTENCES["pl"][1] * 5000)]
    got = {r["doc_id"]: r["detected"] for r in pages.detect_language(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "en", 2: "en", 3: "en", 4: "bg", 5: "ru", 6: "ja", 7: "it", 8: "pl"}
