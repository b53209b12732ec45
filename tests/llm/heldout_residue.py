"""Wordings that occur in no seed of the residue models: notices and filler to be found, messages to be left.

Written from notices of public software and from messages of everyday, before the seeds; no row of a test table is in it.
"""

NOTICES = """
The requested topic does not exist.
Invalid Thread specified. If you followed a valid link, please notify the administrator
Error establishing a database connection
There has been a critical error on this website. Please check your site admin email inbox for instructions.
This site can't be reached. example.org refused to connect.
Hmm. We're having trouble finding that site. We can't connect to the server at www.example.org.
Secure Connection Failed. The page you are trying to view cannot be shown because the authenticity of the received data could not be verified.
The web server reported a bad gateway error. Ray ID: 77af0c21
Attention Required! Please complete the security check to access example.org
Please stand by, while we are checking your browser before accessing the forum. Redirecting...
JavaScript is not available. We've detected that JavaScript is disabled in this browser.
You need a browser with JavaScript support to use this application
For full functionality of this site it is necessary to enable JavaScript. Here are the instructions how to enable JavaScript in your web browser.
This website works best with JS enabled
Our systems have detected unusual traffic from your computer network.
DNS_PROBE_FINISHED_NXDOMAIN
502 Bad Gateway nginx/1.18.0
Not Found. The requested URL /index.php was not found on this server. Apache/2.4.41 Server at Port 80
Parse error: syntax error, unexpected end of file in /home/u1/public_html/wp-config.php on line 90
Traceback (most recent call last): File "app.py", line 7, in <module> KeyError: 'user'
java.lang.NullPointerException at com.shop.Main.run(Main.java:42)
Uncaught TypeError: Cannot read properties of undefined (reading 'map')
ORA-01034: the database is not available
You are not logged in or you do not have permission to access this page. Log in
The server is temporarily unable to service your request due to maintenance downtime or capacity problems.
Your account has been locked, contact the site owner
Oops! That page can't be found. It looks like nothing was found at this location.
This content isn't available right now
La ressource que vous cherchez n'existe plus sur ce site
Impossible d'afficher la page. Vérifiez l'adresse saisie ou votre connexion.
La page que vous recherchez a peut-être été supprimée, renommée ou est momentanément indisponible.
Vous n'êtes pas autorisé à consulter ce document
Le site est en cours de maintenance, merci de repasser dans quelques minutes
Votre session a expiré, merci de vous identifier à nouveau
Une erreur technique s'est produite. Nos équipes ont été prévenues.
Ce contenu nécessite que JavaScript soit activé dans votre navigateur
Pour utiliser cette application, merci d'autoriser les scripts et les cookies
Le serveur est surchargé, veuillez patienter puis rafraîchir la page
Erreur SQL : la requête a échoué
La discussion demandée n'est plus accessible aux visiteurs
الموقع تحت الصيانة نعود قريبا
عفوا، الرابط الذي اتبعته غير صحيح أو أن الصفحة قد حذفت
لا تملك الصلاحية الكافية لمشاهدة هذا القسم
خطأ في الاتصال بالخادم، أعد المحاولة بعد قليل
يجب عليك تسجيل الدخول أو التسجيل لمشاهدة الموضوع
المتصفح الذي تستعمله لا يدعم جافا سكريبت
يحتاج هذا التطبيق إلى تفعيل جافا سكريبت وملفات الارتباط
انتهت مدة الجلسة، سجل دخولك مرة أخرى
تعذر تحميل المحتوى، تحقق من اتصالك بالإنترنت
الموضوع الذي طلبته غير موجود أو تم حذفه من الإدارة
erreur: had la page ma kach, weli l la page principale
site ta7t la maintenance, weli men be3d
serveur rah tayeh, 3awed jareb chwiya men be3d
lazem tfe3el javascript f le navigateur bach tkemel
الصفحة هادي ما كاش منها، ولي للصفحة الرئيسية
""".strip().splitlines()

FILLER = """
Sed ut perspiciatis unde omnis iste natus error sit voluptatem
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium
Nam libero tempore, cum soluta nobis est eligendi optio cumque nihil impedit quo minus
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas
Integer posuere erat a ante venenatis dapibus posuere velit aliquet
blah blah blah blah blah blah
bla bla bla bla bla bla
foo bar baz qux foo bar baz
xxxxx xxxxx xxx xxxxxx
asdf asdf asdf jkl jkl
qwerty uiop asdfgh zxcvbn
azertyuiop qsdfghjklm wxcvbn
lorem lorem lorem ipsum lorem
Your text here. Replace this with your own content.
Insérez votre texte ici. Ceci est un faux texte destiné à remplir la page.
هذا نص افتراضي لملء الفراغ ويمكنك تغييره
شسيب شسيب لاتن لاتنم ضصثق ضصثق
texte texte texte texte texte
""".strip().splitlines()

MESSAGES = """
since this morning I keep getting a 404 when I open my bank's page, does anyone else have this or is it just my phone
my brother told me to turn on javascript in the settings and after that the video played without any problem
the server was down all weekend so we played cards with the neighbours instead and honestly it was better
I asked support why my account is locked and they answered after three days with a copy of the same letter
hello everyone, who knows a good website for learning to cook couscous like my grandmother used to make
he wrote lorem ipsum on the poster by mistake and printed two hundred copies, we laughed until the evening
je ne comprends pas pourquoi le site de la mairie affiche une erreur depuis hier, j'avais besoin de mon acte de naissance
mon fils a désactivé les cookies et maintenant plus rien ne marche sur la tablette, vous avez une idée
le serveur du restaurant était très gentil et la page des desserts m'a donné faim
hier soir la connexion était tellement lente que j'ai lu tout un livre en attendant
on a fermé la session avec un poème et tout le monde a applaudi longtemps
j'ai retrouvé la page du livre que tu cherchais, elle était tombée derrière l'armoire
قرأت الصفحة الأولى من الكتاب وأعجبتني كثيرا خاصة وصف المدينة القديمة في الشتاء
الموقع الأثري الذي زرناه أمس جميل جدا والحمد لله على السلامة
صديقي يعمل في صيانة السيارات منذ عشر سنوات ولا يشتكي من شيء
حاولت الاتصال بخالتي البارحة ولم ترد فذهبت إليها بنفسي
راني نحوس على موقع نتاع الكرة نشوف فيه الماتش تاع ليوم
قالي خويا فعل السكريبت من الاعدادات وكي درتها مشات عادي الفيديو
wach rak khouya rani nsaksi 3la le site ta3 la poste ma bghach yhell men lbare7
lyoum ro7t l la mairie w galouli le système tayeh weli ghedwa, kima kol mara
sahbi khdem serveur f restaurant w rah mli7 bezzaf hamdoulah
ma fhemt walou men had le film bessah lakher ta3ou kan chbab
merci beaucoup pour la recette, merci merci, toute la famille a adoré
la la la la la quelle belle chanson, elle me rappelle les vacances à la plage
the first page of the newspaper had a picture of our old school and everyone was crying
""".strip().splitlines()
