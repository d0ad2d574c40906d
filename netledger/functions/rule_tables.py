"""Domain, address, port and health-site tables that decide how traffic is labelled.

Domain pattern tables: one "pattern -> category" per line, the LAST matching line wins.
Token tables: "token, token [+ also] | organisation | category"; a line matches if the name contains any of its tokens
(and the token after the plus sign, where there is one); the FIRST matching line wins.
"""

# Fixed values.
GOOGLE_GATE = (
    "google, gmail, ytimg, youtube, gstatic.com, ggpht.com, app-measurement.com, gvt1.com, ampproject, "
    "crashlytics.com, 2mdn.net, doubleclick.net, 1e100.net, gvt2.com"
)

# Fixed values.
GOOGLE_PATTERNS = r"""
^www\.google\..*$ -> Non-video Content
^google\..*$ -> Non-video Content
^apis.google.com$ -> API
^.*app-measurement\.com$ -> API
^suggestqueries\.google\.com$ -> API
^www\.googleapis\.com$ -> API
^maps\.googleapis\.com$ -> API
^mobilemaps-pa\.googleapis\.com$ -> API
^geomobileservices.*\.googleapis\.com$ -> API
^semanticlocation.*\.googleapis\.com$ -> API
^cloudconfig\.googleapis\.com$ -> API
^footprints-pa\.googleapis\.com$ -> API
^clientservices\.googleapis\.com$ -> API
^voledevice-pa\.googleapis\.com$ -> API
^.*translate.*\.com$ -> API
^chromefeedcontentsuggestions-pa.googleapis.com$ -> API
^.*crashlytics\.com$ -> API
^phonedeviceverification-pa\.googleapis\.com$ -> API
^safebrowsing\.googleapis\.com$ -> API
^mdh-pa\.googleapis\.com$ -> API
^mobilenetworkscoring-pa\.googleapis\.com$ -> API
^firebaseremoteconfig\.googleapis\.com$ -> API
^android-safebrowsing\.google\.com$ -> API
^fonts\.googleapis\.com$ -> API
^dns\.google.*$ -> API
^people-pa\.googleapis\.com$ -> API
^id\.google\..*$ -> Authentication
^accounts\.google\..*$ -> Authentication
^clients.*\.google\..*$ -> Authentication
^cryptauthenrollment\.googleapis\.com$ -> Authentication
^(?:(?!ytimg).)*googleusercontent\.com$ -> Non-video Content
^(?:(?!connectivitycheck).)*gstatic\.com -> Non-video Content
^(?:(?!yt).)*ggpht\.com$ -> Non-video Content
^(?:(?!beacons).)*\.gvt[0-9]*\.com$ -> Mixed CDN
^beacons.*gvt[0-9]*\.com$ -> API
^connectivitycheck\.gstatic\.com$ -> API
^android\.clients\.google\.com$ -> Software or Updates
^play\.googleapis\.com$ -> Software or Updates
^android\.googleapis\.com$ -> Software or Updates
^dl\.google\.com$ -> Software or Updates
^playatoms-pa\.googleapis\.com$ -> Software or Updates
^update\.googleapis\.com$ -> Software or Updates
^play\.google\.com$ -> Software or Updates
^.*googlevideo\.com$ -> Video
^.*ytimg.*$ -> Video
^.*youtube.*$ -> Video
^yt.*\.ggpht\.com$ -> Video
^video\.google\..*$ -> Video
^.*\.doubleclick\.net$ -> Ad Network
^.*googlesyndication\.com$ -> Ad Network
.*2mdn\.net -> Ad Network
^.*googletagservices\.com -> Ad Network
^.*googletagmanager\.com$ -> Ad Network
.*analytics.* -> Ad Network
.*adservice.* -> Ad Network
^datasaver\.googleapis\.com$ -> Compressed Web
^.*ampproject\.org$ -> Compressed Web
^.*ampproject\.net$ -> Compressed Web
^googleweblight\.com$ -> Compressed Web
^litepages\.googlezip\.net$ -> Compressed Web
^ampcid\.google\..*$ -> Compressed Web
^backup\.googleapis\.com$ -> Files
^proxy\.googlezip\.net$ -> Files
^drive\.google\.com$ -> Files
^photos\.googleapis\.com$ -> Content Upload
^compress\.googlezip\.net$ -> Content Upload
^photosdata-pa\.googleapis\.com$ -> Content Upload
^.*content-storage-upload\.googleapis\.com$ -> Content Upload
^mail\.google\.com$ -> Messaging
^inbox\.google\.com$ -> Messaging
^hangouts\.google\..*$ -> Messaging
^.*mtalk.*\.google\.com$ -> API
^instantmessaging-pa\.googleapis\.com$ -> Messaging
^.*gmail\.com$ -> Messaging
"""

# Google names that match no pattern, and category folds.
GOOGLE_FALLBACK_PATTERN = r"googleapis\.com"
GOOGLE_FALLBACK_CATEGORY = "API"
GOOGLE_FOLDS = {"Authentication": "API"}

# Fixed values.
FACEBOOK_GATE = "fbcdn, facebook, fbsbx, fb.com, accountkit.com"

# Fixed values.
FACEBOOK_PATTERNS = r"""
^.*www\.facebook\.com$ -> Social Media
^web\.facebook\.com$ -> Social Media
^facebook\.com$ -> Social Media
^m\.facebook\.com$ -> Social Media
^mobile\.facebook\.com$ -> Social Media
^.*video.*\.facebook\.com$ -> Video
^.*video.*\.fbcdn\.net$ -> Video
^static.*\.fbcdn\.net$ -> Non-video Content
^static.*\.facebook\.com$ -> Non-video Content
^z-m-static.*\.fbcdn\.net$ -> Non-video Content
^.*scontent.*\.fbcdn\.net$ -> Non-video Content
^lookaside.*\.facebook\.com$ -> Non-video Content
^platform-lookaside.*\.fbsbx\.com$ -> Non-video Content
^.*api\.facebook\.com$ -> API
^.*graph\.facebook\.com$ -> Social Media
^portal\.fb\.com$ -> API
^connect\.facebook\.net$ -> Authentication
^connect\.facebook\.com$ -> Authentication
^.*accountkit\.com$ -> Authentication
^fbsbx\.com$ -> Mixed CDN
^cdn.fbsbx.com$ -> Mixed CDN
^edgeray.*\.facebook\.com$ -> Mixed CDN
^edge-star.*\.facebook\.com$ -> Mixed CDN
^external.*\.fbcdn\.net$ -> Mixed CDN
^z-m-external.*\.fbcdn\.net$ -> Mixed CDN
^snaptu.*\.facebook\.com$ -> Compressed Web
^edge-snaptu.*\.facebook\.com$ -> Compressed Web
^.*upload.*\.facebook\.com$ -> Content Upload
^.*upload.*\.fbcdn\.com$ -> Content Upload
^.*upload.*\.fbcdn\.net$ -> Content Upload
^lithium.*\.facebook\.com$ -> Ad Network
^an\.facebook\.com$ -> Ad Network
^mqtt.*\.facebook\.com$ -> Messaging
^.*edge-mqtt.*\.facebook\.com$ -> Messaging
^.*edge-chat\.facebook\.com$ -> Messaging
^edge-stun.*\.facebook\.com$ -> Messaging
^stun.*\.facebook\.com$ -> Messaging
^edge-turnservice.*\.facebook\.com$ -> Messaging
^whatsapp.*\.fbcdn\.net$ -> Messaging
^.*whatsapp.*\.facebook\.com$ -> Messaging
^instagram.*\.fbcdn\.net -> Social Media
^instagram.*\.facebook\.com -> Social Media
"""

# Fixed values.
FACEBOOK_FOLDS = {"Mixed CDN": "Social Media", "Non-video Content": "Social Media", "Authentication": "API"}

# Fixed values.
DOMAIN_TOKENS = """
whatsapp | WhatsApp | Messaging
twimg, twitter + video | Twitter | Video
twimg, twitter | Twitter | Social Media
instagram | Instagram | Social Media
wikipedia | Wikipedia | Non-video Content
amazonaws, aws.com | Amazon Web Services | IAAS
amazon | Amazon | Non-video Content
livestream818.com | 818 Religious Conference | Video
network.bokondini | Local Services | Local Services
content.bokondini | Local Services | Local Services
xvideos-cdn.com, xvideos.com | xvideos | Adult Video
xnxx-cdn.com, xnxx.com | xnxx | Adult Video
trggames.com | TRG Games | Games
nearme.com.cn | Oppo | API
coloros.com | Oppo | Software or Updates
oppomobile.com | Oppo | Software or Updates
igamecj.com, file-igamecj.akamaized.net | IgameCJ | Games
vivoglobal.com, vivo.com | Vivo | Software or Updates
vidio.com, vidio-com.akamaized.net, vidio.static6.com | Vidio | Video
tudoo.mobi | Tudoo | Video
tiktokcdn.com, tiktokv.com, muscdn.com, tiktokcdn-com, byteoversea.com, musical.ly | TikTok | Video
topbuzzcdn.com | TopBuzz | Mixed CDN
phncdn.com | PHN CDN | Mixed CDN
rqmob.com | RQ Mob | Ad Network
pubgmobile.com | PUBG | Games
wshareit.com | W Share It | Video
samsungdm.com | Samsung | Software or Updates
windowsupdate.com | Microsoft (non-azure) | Software or Updates
dl.delivery.mp.microsoft.com | Microsoft (non-azure) | Software or Updates
officecdn.microsoft.com.edgesuite.net | Microsoft (non-azure) | Software or Updates
download.microsoft.com | Microsoft (non-azure) | Software or Updates
azure | Azure (Microsoft) | IAAS
tokopedia.net | Tokopedia | Non-video Content
9appsdownloading.com, 9appsinstall.com | UC Browser | Software or Updates
ucweb.com | UC Browser | Compressed Web
liftoff.io | Liftoff | Ad Network
avatar. + .com | Avatar Tracker | Ad Network
v-mate.mobi | VMate | Video
emome-ip.hinet.net | HiNet | IAAS
like.video, bigo.sg, likeevideo.com, like-video.com | Likee | Video
hlssrv.com | HLSPlay | Video
opera-mini.net, operacdn.com, transcoder.opera.com, mobile.opera.com | Opera Mini | Compressed Web
im-gb.com | Im-Gb | Compressed Web
img.vidmatefilm.org | VidMateFilm | Video
videoxcdn.net | VideoX | Adult Video
bioskopview.com | Bioskopview | Video
adcolony.com | Adcolony | Ad Network
www2090.o0-5.com | Fembed | Video
cootek.com | Cootek | Mixed CDN
unityads.unity3d.com | Unity Ads | Ad Network
az-dn.gw.samsungapps.com | Samsung | Software or Updates
hiido.com | Hiido | Files
cf.shopee.co.id, shopeemobile.com, shopee.co.id | Shopee | Non-video Content
amplitude.com | Amplitude | Ad Network
ivideosmart.com | iVideoSmart | Ad Network
mangatoon.100sta.com, mangatoon.mobi, mangatoon.akamaized.net | Mangatoon | Non-video Content
ushareit | UshareIt | Files
au.ff.avast.com | Avast | Antivirus
symantecliveupdate.com | Symantic | Antivirus
definitionupdates.microsoft.com | Microsoft | Antivirus
mcafee.com | McAfee | Antivirus
tenor.co | Tenor | Non-video Content
giphy.com | Giphy | Non-video Content
qq.com, myqcloud.com | QQ | Messaging
idnview.com | Idn View | Video
joox.com | Joox | Non-video Content
baca.co.id | Baca | Non-video Content
weathercn.com | Weather CN | Non-video Content
vungle.com | Vungle | Ad Network
iprimus.net.au | iPrimus | IAAS
cdnsyy.com | cdn syy | Mixed CDN
uodoo.com | Uodoo | Non-video Content
applovin.com | AppLovin | Ad Network
shareitgames.com | ShareIt Games | Games
adjust.com | AdJust | Ad Network
waptrick.org | WapTrick | Non-video Content
idtribun.com | Idtribun | Games
topwin-movie-maker.com | Topwin | Video
idkasino.com | ID Kasino | Games
adsmoloco.com | Moloco | Ad Network
menangtoto.pw | Menangtoto | Games
ev.rdtcdn.com | RdtCDN | Mixed CDN
boy18tube.com | Boy 18 | Adult Video
cdncollection.com | CDN Collection | Games
mopub.com, snipermob.com | MoPub | Ad Network
vidmate.net, vidmatefilm.org | Vidmate | Video
cdn.mozilla.net | Mozilla | Software or Updates
pkvn.mobi | Pkvn | Games
ssacdn.com | Supersonic Games | Games
pinimg.com, pinterest | Pinterest | Non-video Content
carageo.com | CaraGeo | Files
majorgeeks.com | MajorGeeks | Software or Updates
slatic.net | Slatic | Non-video Content
download.mediatek.com | Mediatek | Software or Updates
download.adobe.com | Adobe | Software or Updates
rdtcdn.com | Rdt CDN | Mixed CDN
linode.com | Linode | IAAS
bukalapak.com | Bukalapak | Non-video Content
adtilt.com | Adtilt | Ad Network
feedify.net | Feedify | Ad Network
snapchat.com | Snapchat | Video
alicdn.com | Alibaba CDN | Mixed CDN
ksmobile.com | KS Mobile | Software or Updates
unrulymedia.com | Unruly Media | Ad Network
blogspot.com | Blogspot | Non-video Content
akamai | Akamai | Mixed CDN
cloudfront | AWS Cloudfront | Mixed CDN
cloudflare | Cloudflare | Mixed CDN
snssdk.com | SN China | API
xiaomi.com | Xiaomi | Software or Updates
"""

# Fixed values: "address text | organisation | category"; a leading ^ anchors the text at the start.
ADDRESS_TOKENS = """
157.240.25., 157.240.24., 157.240.2. | Facebook | Unknown (Not Mapped)
164.90.115., 164.90.78., 169.136.70., 169.136.65. | Likee | Video
202.80.222. | Kabel Mediacom | Unknown (Not Mapped)
169.136.65.204 | QQ | Messaging
107.150.124., 23.248.162. | UCloud | Games
^74.125., ^173.194. | Google | Google (No DNS)
104.248.148.225 | Digital Ocean | IAAS
8.37.232.4 | Level3 | IAAS
^168.235.199. | Quantil Networks | Mixed CDN
"""

# Fixed values: "protocol port | plain name"; other TCP, UDP and protocols have their own names.
PORT_NAMES = """
6 22 | SSH
6 25 | SMTP
6 53 | DNS
6 80 | HTTP
6 143 | IMAP
6 220 | IMAP
6 443 | HTTPS
6 993 | IMAP
6 5349 | STUN/TURN TLS
17 53 | DNS
17 80 | HTTP/3 (QUIC)
17 123 | NTP
17 143 | IMAP
17 443 | HTTP/3 (QUIC)
17 3478 | STUN/TURN
"""
OTHER_NAMES = {6: "Other TCP", 17: "Other UDP"}
OTHER_PROTOCOL = "Other"

# Fixed values (names are lower-cased before the test, so the mixed-case token cannot match).
HEALTH_TOKENS = """
infeksi kemkes covid corona korona kesehatan kesegaran kewarasan dokter doktor pengobat mengobati merawat penyakit
who health virus vaccine vaksin PeduliLindungi peduli lindungi medical telemedicine medicine obat
"""

# Fixed values.
HEALTH_EXCLUSIONS = """
wholesale
antivirus
mobihealthplus.com.
bras-base-hpwhon5203w-grc-03-65-94-57-54.dsl.bell.ca
the-who-8.core.ynet.pl
adminmusic-test.mobihealthplus.com
whos.amung.us
samsunghealth.com
samsungcloud.com
coronalabs.com
unhealthyrange.com
bpjs-kesehatan.go.id
wholeless-mileage.volia.net
whoareyou.ff.garena.com
hologfx.com
acrobat.com
adobe.com
tanobato.wordpress.com
sobatdrama.net.
sobatkerja.zendesk.com.
sobatmateri.com
sobatnewss.blogspot.com.
sobat-otomotif.blogspot.com
comm.miui.com.
jualobatpembesarpenisherbalklg.blogspot.com.
dunia-kesehatan01.blogspot.com.
kesehatan.kontan.co.id.
health.detik.com.
health.kompas.com.
healthcareitnews.com.
"""

# Full names whose primary domain is set by hand.
PRIMARY_DOMAIN_ALIASES = """
alodokter.page.link. -> alodokter.com.
alodokterdev.page.link. -> alodokter.com.
alodokterstaging.page.link. -> alodokter.com.
doktersehat.onesignal.com. -> doktersehat.com.
"""

# IPv4 blocks that are not globally reachable (multicast counts as reachable).
NOT_GLOBAL_IPV4 = """
0.0.0.0/8
10.0.0.0/8
100.64.0.0/10
127.0.0.0/8
169.254.0.0/16
172.16.0.0/12
192.0.0.0/29
192.0.0.170/31
192.0.2.0/24
192.168.0.0/16
198.18.0.0/15
198.51.100.0/24
203.0.113.0/24
240.0.0.0/4
"""

# The same for fully written-out IPv6 addresses, as patterns.
NOT_GLOBAL_IPV6 = r"""
^0000:0000:0000:0000:0000:0000:0000:000[01]$
^0000:0000:0000:0000:0000:ffff:
^0100:0000:0000:0000:
^2001:0[01][0-9a-f]{2}:
^2001:0db8:
^f[cd]
^fe[89ab]
"""


def lines(text: str) -> list[str]:
    return [line for line in text.strip().splitlines() if line]


def patterns(text: str) -> list[tuple[str, str]]:
    return [tuple(line.rsplit(" -> ", 1)) for line in lines(text)]


def token_rules(text: str) -> list[tuple[list[str], str | None, str, str]]:
    """(tokens, additionally required token or None, organisation, category) per line."""
    rules = []
    for line in lines(text):
        test, org, category = line.split(" | ")
        tokens, _, also = test.partition(" + ")
        rules.append((tokens.split(", "), also or None, org, category))
    return rules
