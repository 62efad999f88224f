"""Language guesses of Latin texts by character n-grams.

The profiles are counted from the sample texts below: own sentences of everyday and legal prose, some nine hundred
characters of each language. A caller may give a table of larger ones (lang, text).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping

import numpy as np

#: Orders of the n-grams, pseudo-count of every possible one, and units per natural logarithm.
ORDERS = (1, 2, 3)
PSEUDO = 0.02
SCALE = 100

SAMPLES = {
    "en": "We collect the information that you give us when you create an account, and we use it to provide the service. You may withdraw your consent at any time by writing to us. This policy explains which data we process, why we need them and how long they are kept. If you do not agree with these terms, please stop using our website. The weather was cold yesterday, but the children still went outside and played in the garden until it was dark. She has been working there for three years and would like to move to another town. There is nothing that should be changed without asking everyone who will be affected. Our partners can also show advertisements which are based on what you have read before. They were not able to find out whether the train had already left. Most people think that it is easier to learn through practice than from books.",
    "fr": "Nous recueillons les informations que vous nous donnez lorsque vous créez un compte, et nous les utilisons pour fournir le service. Vous pouvez retirer votre consentement à tout moment en nous écrivant. Cette politique explique quelles données sont traitées, pourquoi nous en avons besoin et combien de temps elles sont conservées. Si vous n'acceptez pas ces conditions, veuillez ne plus utiliser notre site. Hier il faisait froid, mais les enfants sont tout de même sortis et ont joué dans le jardin jusqu'à la nuit. Elle y travaille depuis trois ans et voudrait déménager dans une autre ville. Rien ne doit être changé sans l'accord de tous ceux qui seront concernés. Nos partenaires peuvent aussi afficher des publicités qui reposent sur ce que vous avez lu auparavant. Ils n'ont pas pu savoir si le train était déjà parti. La plupart des gens pensent qu'il est plus facile d'apprendre par la pratique que dans les livres.",
    "de": "Wir erheben die Angaben, die Sie uns beim Anlegen eines Kontos machen, und verwenden sie, um den Dienst bereitzustellen. Sie können Ihre Einwilligung jederzeit widerrufen, indem Sie uns schreiben. Diese Erklärung sagt, welche Daten verarbeitet werden, wozu wir sie brauchen und wie lange sie gespeichert bleiben. Wenn Sie mit diesen Bedingungen nicht einverstanden sind, nutzen Sie unsere Seite bitte nicht weiter. Gestern war es kalt, aber die Kinder gingen trotzdem hinaus und spielten im Garten, bis es dunkel wurde. Sie arbeitet dort seit drei Jahren und möchte in eine andere Stadt ziehen. Nichts soll geändert werden, ohne dass alle gefragt werden, die es betrifft. Unsere Partner können auch Werbung zeigen, die auf dem beruht, was Sie zuvor gelesen haben. Niemand wusste, ob der Zug schon abgefahren war. Die meisten Menschen glauben, dass man durch Übung leichter lernt als aus Büchern.",
    "es": "Recopilamos la información que usted nos facilita al crear una cuenta y la utilizamos para prestar el servicio. Puede retirar su consentimiento en cualquier momento escribiéndonos. Esta política explica qué datos tratamos, por qué los necesitamos y durante cuánto tiempo se conservan. Si no está de acuerdo con estas condiciones, deje de usar nuestro sitio. Ayer hacía frío, pero los niños salieron de todos modos y jugaron en el jardín hasta que se hizo de noche. Ella trabaja allí desde hace tres años y quiere mudarse a otra ciudad. Nada debe cambiarse sin preguntar a todos los que se verán afectados. Nuestros socios también pueden mostrar anuncios basados en lo que ha leído antes. No pudieron averiguar si el tren ya había salido. La mayoría de las personas cree que es más fácil aprender con la práctica que con los libros. Ahora mismo hay muchas cosas que hacer, aunque nadie sabe cuáles son las más importantes.",
    "it": "Raccogliamo le informazioni che ci fornisci quando crei un account e le usiamo per erogare il servizio. Puoi revocare il tuo consenso in qualsiasi momento scrivendoci. Questa informativa spiega quali dati vengono trattati, perché ne abbiamo bisogno e per quanto tempo sono conservati. Se non sei d'accordo con queste condizioni, smetti di usare il nostro sito. Ieri faceva freddo, ma i bambini sono usciti lo stesso e hanno giocato in giardino finché non è diventato buio. Lei lavora lì da tre anni e vorrebbe trasferirsi in un'altra città. Niente deve essere cambiato senza chiedere a tutti quelli che ne saranno interessati. I nostri partner possono anche mostrare annunci che si basano su ciò che hai letto prima. Non sono riusciti a sapere se il treno fosse già partito. La maggior parte delle persone pensa che sia più facile imparare con la pratica che dai libri. Gli ospiti degli altri alberghi dovranno pagare anche questo.",
    "pt": "Recolhemos as informações que você nos dá quando cria uma conta e usamos esses dados para prestar o serviço. Pode retirar o seu consentimento a qualquer momento, escrevendo para nós. Esta política explica quais dados são tratados, por que precisamos deles e por quanto tempo são guardados. Se não concorda com estes termos, deixe de usar o nosso site. Ontem estava frio, mas as crianças saíram mesmo assim e brincaram no jardim até ficar escuro. Ela trabalha lá há três anos e gostaria de se mudar para outra cidade. Nada deve ser mudado sem perguntar a todos os que serão afetados. Os nossos parceiros também podem mostrar anúncios que se baseiam naquilo que leu antes. Eles não conseguiram saber se o comboio já tinha partido. A maioria das pessoas acha que é mais fácil aprender com a prática do que nos livros. Não há ninguém que possa fazer isso melhor, e as condições são muito boas. O acordo foi assinado pelas duas partes e é válido em todo o país, segundo a lei.",
    "nl": "Wij verzamelen de gegevens die u ons geeft wanneer u een account aanmaakt en gebruiken ze om de dienst te leveren. U kunt uw toestemming op elk moment intrekken door ons te schrijven. Dit beleid legt uit welke gegevens worden verwerkt, waarom we ze nodig hebben en hoe lang ze worden bewaard. Als u het niet eens bent met deze voorwaarden, gebruik onze website dan niet meer. Gisteren was het koud, maar de kinderen gingen toch naar buiten en speelden in de tuin tot het donker werd. Zij werkt daar al drie jaar en zou graag naar een andere stad verhuizen. Er mag niets veranderd worden zonder iedereen te vragen die ermee te maken heeft. Onze partners kunnen ook advertenties tonen die zijn gebaseerd op wat u eerder hebt gelezen. Ze konden niet nagaan of de trein al vertrokken was. De meeste mensen denken dat je door oefening makkelijker leert dan uit boeken.",
    "pl": "Zbieramy informacje, które podajesz nam podczas zakładania konta, i wykorzystujemy je do świadczenia usługi. Możesz wycofać swoją zgodę w dowolnym momencie, pisząc do nas. Niniejsza polityka wyjaśnia, jakie dane przetwarzamy, dlaczego ich potrzebujemy i jak długo są przechowywane. Jeśli nie zgadzasz się z tymi warunkami, przestań korzystać z naszej strony. Wczoraj było zimno, ale dzieci i tak wyszły na dwór i bawiły się w ogrodzie, aż zrobiło się ciemno. Ona pracuje tam od trzech lat i chciałaby się przeprowadzić do innego miasta. Niczego nie należy zmieniać bez pytania wszystkich, których to będzie dotyczyć. Nasi partnerzy mogą także wyświetlać reklamy oparte na tym, co wcześniej czytałeś. Nie udało się ustalić, czy pociąg już odjechał. Większość ludzi uważa, że łatwiej jest uczyć się przez praktykę niż z książek. Proszę wysłać wiadomość przed końcem tygodnia.",
    "cs": "Shromažďujeme informace, které nám poskytnete při vytváření účtu, a používáme je k poskytování služby. Svůj souhlas můžete kdykoli odvolat tím, že nám napíšete. Tyto zásady vysvětlují, jaké údaje zpracováváme, proč je potřebujeme a jak dlouho se uchovávají. Pokud s těmito podmínkami nesouhlasíte, přestaňte prosím naše stránky používat. Včera byla zima, ale děti přesto vyšly ven a hrály si na zahradě, dokud se nesetmělo. Ona tam pracuje už tři roky a ráda by se přestěhovala do jiného města. Nic by se nemělo měnit bez toho, aby byli dotázáni všichni, kterých se to týká. Naši partneři mohou také zobrazovat reklamy, které vycházejí z toho, co jste dříve četli. Nepodařilo se zjistit, zda vlak již odjel. Většina lidí si myslí, že je snazší učit se praxí než z knih. Nemůžeme říci, kdy bude nová smlouva podepsána, protože to ještě není jisté.",
    "hu": "Összegyűjtjük azokat az adatokat, amelyeket a fiók létrehozásakor ad meg nekünk, és a szolgáltatás nyújtásához használjuk fel őket. Hozzájárulását bármikor visszavonhatja, ha ír nekünk. Ez a tájékoztató elmagyarázza, milyen adatokat kezelünk, miért van szükségünk rájuk, és meddig őrizzük meg azokat. Ha nem ért egyet ezekkel a feltételekkel, kérjük, ne használja tovább a honlapunkat. Tegnap hideg volt, de a gyerekek mégis kimentek, és a kertben játszottak, amíg be nem sötétedett. Három éve dolgozik ott, és szeretne egy másik városba költözni. Semmit sem szabad megváltoztatni anélkül, hogy megkérdeznénk mindenkit, akit érint. Partnereink olyan hirdetéseket is megjeleníthetnek, amelyek azon alapulnak, amit korábban olvasott. Nem tudták kideríteni, hogy a vonat elment-e már. A legtöbb ember szerint könnyebb gyakorlással tanulni, mint könyvekből.",
    "ro": "Colectăm informațiile pe care ni le oferiți atunci când creați un cont și le folosim pentru a furniza serviciul. Vă puteți retrage consimțământul în orice moment scriindu-ne. Această politică explică ce date prelucrăm, de ce avem nevoie de ele și cât timp sunt păstrate. Dacă nu sunteți de acord cu acești termeni, vă rugăm să nu mai utilizați site-ul nostru. Ieri a fost frig, dar copiii au ieșit totuși afară și s-au jucat în grădină până s-a întunecat. Ea lucrează acolo de trei ani și ar vrea să se mute în alt oraș. Nimic nu trebuie schimbat fără a-i întreba pe toți cei care vor fi afectați. Partenerii noștri pot afișa și reclame care se bazează pe ceea ce ați citit înainte. Nu au reușit să afle dacă trenul plecase deja. Cei mai mulți oameni cred că este mai ușor să înveți prin practică decât din cărți. Contractul va fi semnat după ce toate părțile îl vor accepta.",
    "tr": "Hesap oluştururken bize verdiğiniz bilgileri topluyor ve bunları hizmeti sunmak için kullanıyoruz. Bize yazarak onayınızı istediğiniz zaman geri çekebilirsiniz. Bu politika hangi verileri işlediğimizi, bunlara neden ihtiyaç duyduğumuzu ve ne kadar süre sakladığımızı açıklar. Bu koşulları kabul etmiyorsanız lütfen sitemizi kullanmayı bırakın. Dün hava soğuktu ama çocuklar yine de dışarı çıktı ve hava kararana kadar bahçede oynadı. Üç yıldır orada çalışıyor ve başka bir şehre taşınmak istiyor. Etkilenecek herkese sorulmadan hiçbir şey değiştirilmemelidir. Ortaklarımız daha önce okuduklarınıza dayanan reklamlar da gösterebilir. Trenin çoktan kalkıp kalkmadığını öğrenemediler. Çoğu insan uygulama yaparak öğrenmenin kitaplardan öğrenmekten daha kolay olduğunu düşünür. Yarın sabah erken kalkmak zorunda olduğumuz için bu akşam evde kalacağız.",
    "sv": "Vi samlar in de uppgifter som du ger oss när du skapar ett konto och använder dem för att tillhandahålla tjänsten. Du kan när som helst återkalla ditt samtycke genom att skriva till oss. Den här policyn förklarar vilka uppgifter vi behandlar, varför vi behöver dem och hur länge de sparas. Om du inte godkänner dessa villkor ska du sluta använda vår webbplats. I går var det kallt, men barnen gick ändå ut och lekte i trädgården tills det blev mörkt. Hon har arbetat där i tre år och vill gärna flytta till en annan stad. Ingenting får ändras utan att man frågar alla som berörs. Våra partner kan också visa annonser som bygger på vad du har läst tidigare. De kunde inte ta reda på om tåget redan hade gått. De flesta människor tycker att det är lättare att lära sig genom övning än ur böcker. Något måste göras innan året är slut, och det är för sent att vänta.",
    "fi": "Keräämme tiedot, jotka annat meille luodessasi tilin, ja käytämme niitä palvelun tarjoamiseen. Voit peruuttaa suostumuksesi milloin tahansa kirjoittamalla meille. Tämä käytäntö kertoo, mitä tietoja käsittelemme, miksi tarvitsemme niitä ja kuinka kauan niitä säilytetään. Jos et hyväksy näitä ehtoja, lopeta sivustomme käyttäminen. Eilen oli kylmä, mutta lapset menivät silti ulos ja leikkivät puutarhassa, kunnes tuli pimeä. Hän on työskennellyt siellä kolme vuotta ja haluaisi muuttaa toiseen kaupunkiin. Mitään ei pidä muuttaa kysymättä kaikilta, joihin se vaikuttaa. Kumppanimme voivat myös näyttää mainoksia, jotka perustuvat siihen, mitä olet aiemmin lukenut. He eivät saaneet selville, oliko juna jo lähtenyt. Useimmat ihmiset ajattelevat, että on helpompi oppia harjoittelemalla kuin kirjoista.",
    "vi": "Chúng tôi thu thập thông tin mà bạn cung cấp khi tạo tài khoản và sử dụng chúng để cung cấp dịch vụ. Bạn có thể rút lại sự đồng ý của mình bất cứ lúc nào bằng cách viết thư cho chúng tôi. Chính sách này giải thích dữ liệu nào được xử lý, tại sao chúng tôi cần và chúng được lưu giữ trong bao lâu. Nếu bạn không đồng ý với các điều khoản này, vui lòng ngừng sử dụng trang web. Hôm qua trời lạnh nhưng bọn trẻ vẫn ra ngoài chơi trong vườn cho đến khi trời tối. Cô ấy đã làm việc ở đó ba năm và muốn chuyển đến một thành phố khác. Không nên thay đổi điều gì mà không hỏi tất cả những người bị ảnh hưởng. Họ không biết tàu đã rời đi hay chưa. Hầu hết mọi người nghĩ rằng học qua thực hành dễ hơn học từ sách vở.",
    "id": "Kami mengumpulkan informasi yang Anda berikan saat membuat akun dan menggunakannya untuk menyediakan layanan. Anda dapat menarik persetujuan Anda kapan saja dengan menulis kepada kami. Kebijakan ini menjelaskan data apa yang kami proses, mengapa kami membutuhkannya, dan berapa lama data tersebut disimpan. Jika Anda tidak setuju dengan ketentuan ini, harap berhenti menggunakan situs kami. Kemarin cuacanya dingin, tetapi anak-anak tetap keluar dan bermain di kebun sampai hari gelap. Dia sudah bekerja di sana selama tiga tahun dan ingin pindah ke kota lain. Tidak ada yang boleh diubah tanpa bertanya kepada semua orang yang akan terpengaruh. Mereka tidak bisa mengetahui apakah keretanya sudah berangkat. Kebanyakan orang berpikir bahwa belajar melalui latihan lebih mudah daripada dari buku.",
}

_BREAK = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-case letters, one blank for whatever is between, before and behind them."""
    return f" {_BREAK.sub(' ', text.lower()).strip()} "


def grams(text: str, n: int) -> list[str]:
    return [text[i : i + n] for i in range(len(text) - n + 1)]


def profiles(samples: Mapping[str, str] = SAMPLES) -> tuple[list[str], dict[int, dict[str, list[int]]], dict[int, list[int]]]:
    """Languages (en first, then by name); per order the weights of each n-gram of any sample, one per language, and those
    of all other n-grams. A weight is SCALE times the logarithm of (count + PSEUDO) / (all counts + PSEUDO * (known + 1))."""
    langs = sorted(samples, key=lambda lang: (lang != "en", lang))
    known, other = {}, {}
    for n in ORDERS:
        counts = {lang: Counter(grams(plain(samples[lang]), n)) for lang in langs}
        seen = sorted({g for c in counts.values() for g in c})
        total = {lang: sum(counts[lang].values()) + PSEUDO * (len(seen) + 1) for lang in langs}
        weight = lambda lang, k: round(SCALE * math.log((k + PSEUDO) / total[lang]))  # noqa: B023, E731
        known[n] = {g: [weight(lang, counts[lang][g]) for lang in langs] for g in seen}
        other[n] = [weight(lang, 0) for lang in langs]
    return langs, known, other


class Guesser:
    """Profiles as arrays: letters become small numbers and n-grams the places of their weights."""

    def __init__(self, samples: Mapping[str, str] = SAMPLES, step: int = 1 << 15):
        self.langs, known, other = profiles(samples)
        letters = sorted({c for g in known[1] for c in g})
        self.base, self.step = len(letters) + 1, step
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, self.base)
        self.place, self.weights = {}, {}
        for n in ORDERS:
            place = np.zeros(self.base**n, np.int32)
            for i, g in enumerate(known[n], 1):
                place[self._codes(self.letter[[ord(c) for c in g]], n)] = i
            self.place[n], self.weights[n] = place, np.array([other[n], *known[n].values()], np.float64)  # whole numbers

    def _codes(self, numbers: np.ndarray, n: int) -> np.ndarray:
        code = np.zeros(max(0, len(numbers) - n + 1), np.int64)
        for i in range(n):
            code = code * self.base + numbers[i : i + len(code)]
        return code

    def scores(self, text: str) -> np.ndarray:
        """Sum of weights per language, over the whole text."""
        points = np.frombuffer(plain(text).encode("utf-32-le", "replace"), np.uint32)
        total = np.zeros(len(self.langs))
        for n in ORDERS:
            weights = self.weights[n]
            for at in range(0, max(0, len(points) - n + 1), self.step):
                places = self.place[n][self._codes(self.letter[points[at : at + self.step + n - 1]], n)]
                total += weights[places].sum(0) if len(places) < len(weights) // 4 else np.bincount(places, minlength=len(weights)) @ weights
        return total

    def guess(self, text: str) -> str:
        """The language with the highest score, the first of equals; en for a text without letters."""
        return self.langs[int(self.scores(text).argmax())] if plain(text).strip() else "en"
