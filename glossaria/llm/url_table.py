"""The small labelled table that the URL model learns from: real hosts of many kinds, written down by hand.

Whole registered domains are held out by a hash of their name, so that no host of a domain is in both parts. Nothing is
taken from the tables that the model is applied to.
"""

from __future__ import annotations

import random
import zlib

from pyspark.sql import DataFrame, SparkSession

#: Hosts that a corpus leaves out: betting, adult, pirated, advertising and tracking, loans, pills and written-to-order.
BLOCKED = """
bet365.com williamhill.com ladbrokes.com coral.co.uk betfair.com unibet.com betway.com 888casino.com 888poker.com pokerstars.com partypoker.com bwin.com
betvictor.com skybet.com betsson.com leovegas.com casumo.com mrgreen.com bet-at-home.com tipico.de interwetten.com pinnacle.com betonline.ag bovada.lv
ignitioncasino.eu sportsbet.com.au bet9ja.com betika.com sportpesa.com 1xbet.com melbet.com 22bet.com mostbet.com parimatch.com dafabet.com 188bet.com
betano.com betclic.fr winamax.fr zebet.fr tonybet.com marathonbet.com betmgm.com fanduel.com pointsbet.com betrivers.com jackpotcitycasino.com spinpalace.com
royalvegascasino.com casinoclassic.eu luckynuggetcasino.com rubyfortune.com playojo.com videoslots.com slotsmillion.com casinoroom.com vulkanvegas.com
joycasino.com pinup-casino.com bitstarz.com cloudbet.com roobet.com lottoland.com jackpotjoy.com galabingo.com meccabingo.com slotomania.com doubledowncasino.com
pornhub.com xvideos.com xnxx.com xhamster.com youporn.com tube8.com spankbang.com eporner.com beeg.com tnaflix.com drtuber.com porntrex.com hclips.com
sunporno.com nuvid.com pornone.com motherless.com brazzers.com bangbros.com realitykings.com naughtyamerica.com chaturbate.com stripchat.com livejasmin.com
bongacams.com myfreecams.com cam4.com camsoda.com flirt4free.com adultfriendfinder.com ashleymadison.com onlyfans.com manyvids.com clips4sale.com literotica.com
nhentai.net hentaihaven.xxx rule34.xxx e-hentai.org hanime.tv sexstories.com escortdirectory.com eurogirlsescort.com adultwork.com sex.com porn.com
thepiratebay.org 1337x.to rarbg.to kickasstorrents.to torrentz2.eu limetorrents.info torrentdownloads.me yts.mx eztv.re nyaa.si zooqle.com torrentfunk.com
demonoid.is isohunt.to rutracker.org rutor.info fmovies.to putlocker.vip 123movies.net soap2day.to gomovies.sx solarmovie.pe primewire.li kinox.to
cuevana3.me pelisplus.to kissanime.ru 9anime.to skidrowreloaded.com oceanofgames.com steamunlocked.net crackwatch.com nulled.to getintopc.com filecr.com
crackstreams.com warez-bb.org mp3juices.cc ytmp3.cc y2mate.com freemoviesfull.com watchserieshd.tv
doubleclick.net googlesyndication.com googleadservices.com adnxs.com taboola.com outbrain.com popads.net propellerads.com adroll.com rubiconproject.com
pubmatic.com openx.net casalemedia.com adform.net smartadserver.com advertising.com zedo.com exoclick.com juicyads.com trafficjunky.com adsterra.com
hilltopads.com mgid.com revcontent.com scorecardresearch.com quantserve.com moatads.com adcolony.com applovin.com bidswitch.net contextweb.com teads.tv
tribalfusion.com serving-sys.com adsafeprotected.com doubleverify.com clickbank.net statcounter.com adsrvr.org bidvertiser.com popcash.net admixer.net
clickadu.com trackingclick.net adtelligent.com mediavine-ads.com affiliatefuture.com trafficfactory.biz
wonga.com quickquid.co.uk speedycash.com moneymutual.com cashnetusa.com checkintocash.com acecashexpress.com paydayloans.com badcreditloans.com cashadvance.com
canadianpharmacyonline.com northwestpharmacy.com buyviagraonline.com genericcialis.com onlinepharmacy24.com cheappills.net edpills.org steroidsfax.com
essayshark.com paperhelp.org edubirdie.com grademiners.com replicawatches.to seoclerks.com backlinksmaster.com freegiftcards.club miracleweightloss.com getrichquick.biz""".split()
#: Hosts of other kinds: press, science, government, software, shops, health, travel, sport, culture, clubs, and names
#: that hold a word of the others.
ALLOWED = """
nytimes.com theguardian.com bbc.co.uk reuters.com apnews.com cnn.com washingtonpost.com economist.com ft.com wsj.com latimes.com npr.org aljazeera.com
spiegel.de zeit.de faz.net sueddeutsche.de tagesschau.de taz.de lemonde.fr lefigaro.fr liberation.fr ouest-france.fr elpais.com elmundo.es lavanguardia.com
corriere.it repubblica.it nrc.nl volkskrant.nl dn.se aftenposten.no politiken.dk hs.fi asahi.com scmp.com thehindu.com smh.com.au nzherald.co.nz
nature.com science.org sciencedirect.com springer.com wiley.com jstor.org plos.org arxiv.org biorxiv.org pnas.org cell.com acm.org ieee.org aps.org
mit.edu stanford.edu harvard.edu berkeley.edu ox.ac.uk cam.ac.uk essex.ac.uk sussex.ac.uk ethz.ch epfl.ch tum.de uni-heidelberg.de sorbonne.fr upm.es
kth.se ku.dk tsinghua.edu.cn u-tokyo.ac.jp unimelb.edu.au utoronto.ca nasa.gov nih.gov noaa.gov usgs.gov census.gov loc.gov gov.uk nhs.uk service-public.fr
bund.de berlin.de europa.eu un.org who.int worldbank.org imf.org oecd.org unesco.org unicef.org redcross.org amnesty.org greenpeace.org wwf.org
wikipedia.org wikidata.org wiktionary.org britannica.com merriam-webster.com dictionary.com gutenberg.org archive.org openlibrary.org goodreads.com
github.com gitlab.com stackoverflow.com python.org rust-lang.org golang.org nodejs.org kernel.org debian.org ubuntu.com fedoraproject.org archlinux.org
apache.org mozilla.org w3.org ietf.org postgresql.org sqlite.org docker.com kubernetes.io readthedocs.io jquery.com reactjs.org vuejs.org djangoproject.com
numpy.org scipy.org pytorch.org tensorflow.org r-project.org julialang.org mathworks.com wolfram.com arduino.cc raspberrypi.com hackaday.com
microsoft.com apple.com adobe.com oracle.com ibm.com intel.com samsung.com siemens.com bosch.com philips.com sony.com nintendo.com lego.com
amazon.com ebay.com ikea.com otto.de zalando.de decathlon.fr rei.com etsy.com target.com walmart.com bestbuy.com homedepot.com tesco.com carrefour.fr
mayoclinic.org clevelandclinic.org webmd-journal.org healthline.com medlineplus.gov cancer.org heart.org psychologytoday.com nice.org.uk charite.de
tripadvisor.com booking.com lonelyplanet.com expedia.com airbnb.com bahn.de sncf.com renfe.com amtrak.com heathrow.com lufthansa.com klm.com visitbritain.com
fifa.com uefa.com nba.com nfl.com mlb.com espn.com olympics.com worldathletics.org trackandfieldnews.com cyclingnews.com runnersworld.com chess.com lichess.org
moma.org metmuseum.org tate.org.uk louvre.fr museodelprado.es rijksmuseum.nl vam.ac.uk smithsonian.org nationalgallery.org.uk royalacademy.org.uk
imdb.com rottentomatoes.com metacritic.com allmusic.com discogs.com last.fm rollingstone.com pitchfork.com classicfm.com berliner-philharmoniker.de
allrecipes.com bonappetit.com seriouseats.com chefkoch.de marmiton.org bbcgoodfood.com kingarthurbaking.com epicurious.com cocktailsandbars.com
nationalgeographic.com smithsonianmag.com scientificamerican.com newscientist.com space.com phys.org livescience.com howstuffworks.com
wordpress.org medium.com blogger.com tumblr.com substack.com reddit.com quora.com stackexchange.com ycombinator.com slashdot.org arstechnica.com wired.com
theverge.com engadget.com techcrunch.com anandtech.com tomshardware.com heise.de golem.de clubic.com xataka.com
weather.com accuweather.com wetter.de meteofrance.com timeanddate.com openstreetmap.org mapquest.com
khanacademy.org coursera.org edx.org udacity.com duolingo.com ted.com brilliant.org codecademy.com w3schools.com
betterhomesandgardens.com betterevaluation.org bethesda.net elizabethgaskellhouse.co.uk alphabetbooks.org tibetmuseum.org tibetanreview.net abetterworld.org diabetes.org
diabetes.co.uk sextant-navigation.org middlesexcountynj.gov sussexwildlifetrust.org.uk essexlive.news wessexarch.co.uk unisexclothing-history.org pillsbury.com
pillowbook.org caterpillar.com crackerbarrel.com nutcrackermuseum.com cracow.travel pirateshistory.org shakespeare.org.uk slotcarillustrated.com pokerwork-art.org
adelaide.edu.au adlerplanetarium.org adventist.org academia.edu academyofmusic.org radio-canada.ca canadahistory.com nomadicmatt.com headspace.com leadersinsport.org
railtrackrecords.org tracksmith.com racetrackinfo.org casinoarchitecture-heritage.org torrentialrain-studies.org adulteducation.org cockburn.wa.gov.au scunthorpetelegraph.co.uk
loanlibrary.org farmersalmanac.com pharmacy.ox.ac.uk analyticalchemistry.org pancakehouse.org japantimes.co.jp spokane.edu occasionalpapers.org""".split()
PATHS = ["", "/", "/index.html", "/about", "/en/{n}", "/de/{n}.html", "/fr/{n}", "/{n}", "/p/{n}", "/2024/05/{n}", "/page-{n}.html", "/search?q={n}", "/article/{n}", "/contact", "/help/{n}", "/archive/{n}/"]
BLOCKED_PATHS = ["/bonus", "/free-spins", "/videos/{n}", "/click?id={n}", "/track/{n}", "/torrent/{n}", "/promo/{n}", "/pixel/{n}.gif", "/live-cams", "/buy-now"]
PREFIXES = ["", "www.", "www.", "m.", "en.", "news.", "shop."]
#: One domain in HELD_OUT is kept for the test.
HELD_OUT = 4
_TWO_LEVELS = ("co.uk", "ac.uk", "org.uk", "edu.au", "com.au", "gov.au", "co.nz", "co.jp", "ac.jp", "edu.cn")


def registered_domain(host: str) -> str:
    labels = host.split(".")
    return ".".join(labels[-3:] if ".".join(labels[-2:]) in _TWO_LEVELS else labels[-2:])


def held_out(host: str) -> bool:
    return zlib.crc32(registered_domain(host).encode()) % HELD_OUT == 0


def labelled(test: bool = False, each: int = 6, seed: int = 1) -> list[tuple[str, float]]:
    """``each`` URLs of every host that is held out, or of every other one. Label 1: block. Paths say little by themselves:
    most are of either label."""
    rng, rows = random.Random(seed), []
    for hosts, label in ((BLOCKED, 1.0), (ALLOWED, 0.0)):
        for host in hosts:
            if held_out(host) == test:
                for _ in range(each):
                    path = rng.choice(BLOCKED_PATHS if label and rng.random() < 0.25 else PATHS).replace("{n}", str(rng.randint(1, 99_999)))
                    rows.append((f"http{rng.choice(['', 's'])}://{rng.choice(PREFIXES)}{host}{path}", label))
    return rows


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The table that is learned from: url, label; 1: block."""
    return spark.createDataFrame(labelled(), "url string, label double")
