"""Labelled names by category, to train the URL model on, and a general list of words with counts to cut names with."""

from __future__ import annotations

import json
import re
from functools import lru_cache

#: Kinds of sites to block; one name's words between commas.
BLOCKED_KINDS = {
    "adverts": "ad server, ads server, ads network, adserver, ad click, banner ads, banner exchange, popup ads, popunder, pop under, ad exchange, adnxs, ad sense, ad media, doubleclick, double click ads, ads delivery, ad delivery, ad serving, sponsored ads, advert, adverts, advertising, ad syndication, click ads, pay per click, native ads, video ads, mobile ads, ads api",
    "trackers": "tracker, trackers, tracking, click tracker, pixel tracker, tracking pixel, pixel, track click, track user, telemetry, web beacon, beacon, fingerprint, user tracking, ad tracking, web analytics tracker, stat counter, hit counter, metrics collector, retargeting, remarketing, affiliate tracking, affiliate click, conversion tracker, session replay, spyware",
    "gambling": "casino, online casino, live casino, casino bonus, casino royal, poker, online poker, poker room, video poker, roulette, bingo, bingo hall, blackjack, baccarat, slots, slot machine, mega slots, jackpot, jackpot city, lottery, lotto, bet, bets, betting, sports betting, sportsbook, bookmaker, odds betting, gamble, gambling, gambler, wager, free spins, spins, scratch cards, keno, craps",
    "malware": "malware, malware download, virus, trojan, ransomware, botnet, exploit, exploit kit, exploits, rootkit, keylogger, payload dropper, dropper, infected, worm, adware, hijack, browser hijacker, backdoor, stealer, crypto miner inject, coinhive, fake antivirus, fake codec, drive by infect, hacked, hack tool",
    "phishing": "phishing, phish, account verify, verify account login, secure login verify, confirm password, password reset verify, account suspended, account locked, unlock account, wallet verify, bank login verify, update billing, billing verify, signin verify, credential, fake login, scam, scams, fraud, fake, spoof",
    "adult": "porn, porno, porn tube, free porn, xxx, xxx videos, adult, adult videos, adult chat, adult dating, sex, sex chat, sex cams, sexy, nude, nudes, naked, cams, webcam girls, hot girls, escort, escorts, hentai, erotic, erotica, fetish, milf, lesbian tube, camgirl, strip, stripper, hookup, hookups, x rated, x videos, adult movies, adult content, adult toys, adult webcam, adult sites",
    "drugs": "viagra, cialis, buy viagra, cheap viagra, pills, buy pills online, diet pills, cheap meds, meds no prescription, steroids, buy steroids, cannabis weed, weed shop, tramadol, xanax, buy xanax, oxycodone, levitra, pharma cheap, miracle weight loss, weight loss pills, cocaine, replica drugs",
    "spam": "spam, spammer, spam links, link farm, link exchange, backlinks, buy backlinks, buy followers, buy likes, seo spam, cheap seo, article spinner, bulk email, mass mailer, email blaster, click here, clickbait, chain letter, make money fast, get rich quick, get rich, earn cash fast, work from home cash, free gift cards, gift card generator, free prize, claim prize, win prize, winner prize, lucky winner, you won, free iphone, surveys cash, survey rewards",
    "loans": "payday, payday loans, payday loan, cash advance, fast cash, instant cash loan, bad credit loans, quick loans, easy loans, no credit check, debt relief now, binary options, forex profit, bitcoin doubler, crypto doubler, double bitcoin, pyramid scheme, ponzi, pump dump",
    "piracy": "warez, torrent, torrents, torrent download, crack, cracks, cracked software, keygen, serial keys, serials, nulled, nulled scripts, pirate, piracy, pirated movies, free movies stream, watch free movies, mp3 rip, rapid leech, rip downloads, cracked games, hacks cheats, aimbot, game cheats hack, proxy unblock, unblocked proxy",
    "fakes": "replica watches, replica, replica bags, cheap replica, fake watches, fake id, fake ids, fake passports, counterfeit, counterfeit money, knockoff, cheap oakley, cheap jordans, cheap handbags, essay mill, buy essays, fake diplomas",
}
#: Kinds of sites to allow.
ALLOWED_KINDS = {
    "news": "news, daily news, world news, local news, morning post, evening standard, herald, gazette, tribune, chronicle, times, press, press release, weekly journal, newspaper, magazine, weather, weather report, headlines, radio, public radio, television, broadcast, sports news, politics",
    "learning": "school, high school, primary school, university, college, academy, institute, campus, library, public library, free library, research, science, physics, chemistry, biology, mathematics, history, history archive, archive, archives, museum, science museum, dictionary, encyclopedia, education, learning, online courses, student exchange, exchange program, diet research, virus research, free courses, lecture notes, students, teachers, textbook, philosophy, geography, astronomy, journal",
    "public": "city council, council, county, government, parliament, senate, court, public records, public health, police, fire department, ministry, embassy, elections, tax office, town hall, national park, parks, transport, railway, metro, airport, post office, community center, charity, foundation, church, temple, volunteers",
    "health": "health, health care, hospital, clinic, dental, dentist, doctor, medicine, medical center, pharmacy, nursing, family health, eye care, cancer research, therapy, therapist, nutrition, fitness, yoga, wellness",
    "shops": "shop, www shop, store, book store, bookshop, books, free shipping, cheap flights, furniture, garden, garden center, flowers, kitchen, clothing, shoes, fashion, jewelry, watches, toys, grocery, track order, track packages, track parcel, parcel tracking, click and collect, watch repair, cheap books, cheap tickets, cheap hotels, buy books, buy tickets, market, farm market, supermarket, bakery, bicycle, outdoor, hardware, electronics, cars, auto parts, gift shop, gifts, cards, tools, pets, discount, buy house",
    "technology": "open source, source code, software, free software, software download, download, downloads, docs, documentation, developer, developers, developer api, api, code, programming, python, linux, windows, windows help, mobile, computer, cloud, hosting, server, network, data, database, security, login, account, password manager, support, help, help desk, search, search engine, web mail, mail, email, wiki, forum, chat, blog, science blog, tech review, hardware review, games, game review, video, videos, photo, photos, photo album, music, maps, robotics, web design, link directory, pixel art, screen pixel, web server, time server, file server, double click help, virus scan, session notes, scripts, user guide, user manual, user group, quick start",
    "leisure": "travel, travel guide, hotel, hotels, winter holiday, summer camp, beach, tours, cruise, flights, restaurant, cafe, coffee, pizza, recipes, cooking recipes, cooking, food, wine, farm, organic farm, gardening, art, art gallery, gallery, music review, concert, theater, theatre, cinema, film, film festival, movies, dance, orchestra, poetry, crafts, knitting, photography, hiking, fishing, football, soccer, basketball, tennis, golf, cricket, rugby, cycling, sailing, chess, sports, sports club, running club, race track, track and field, card games, board games, magic tricks, lucky charm, slot cars, royal palace, hall, city hall, city guide, movie stars",
    "business": "bank, savings bank, credit union, insurance, home loans, mortgage, finance, accounting, law firm, lawyers, real estate, property, construction, engineering, consulting, marketing, design studio, architects, jobs, careers, job search, logistics, shipping, energy, solar, electric, water, steel, manufacturing, startup, business, partners, industry, trade fair, conference, events, tickets, cash flow planning, stock exchange, foreign exchange, credit card, debit card, membership card, advertising agency",
    "people": "family, kids, children, parents, baby, wedding, genealogy, biography, memories, friends, neighbors, dating advice, women, men, youth, seniors, alumni, personal blog, diary, portfolio, journal, photo diary, home, house, love poems, adult education, essex, sussex, middlesex, sextant, free time, win win, prize winners, nobel prize",
}


def names(kinds: dict[str, str]) -> tuple[str, ...]:
    return tuple(name.strip() for listed in kinds.values() for name in listed.split(","))


@lru_cache(maxsize=1)
def general_words() -> dict[str, int]:
    """Some ten thousand words with counts by Zipf's law.

    They are the whole words of op1's public vocabularies, whose order of merges is that of frequency in web text: what
    one has as a token at a word's start and the other as one up to a word's end. So most fragments drop out, and the later
    of both places, of which the second list has twice as many, is the rank. Of one and two
    letters only common words count.
    """
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        starts = json.load(f)["model"]["vocab"]
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        ends = json.load(f)["model"]["vocab"]
    found = dict.fromkeys(t[1:].lower() for t in sorted(starts, key=starts.get) if re.fullmatch("Ġ[A-Za-z]+", t))
    short = set("a i of to in is it on he as we at be by do go an or if no up so my me us am".split())
    whole = {w: max(rank, ends[f"{w}</w>"] // 2) for rank, w in enumerate(found) if f"{w}</w>" in ends and (len(w) > 2 or w in short)}
    return {w: 10_000_000 // (rank + 10) for w, rank in whole.items()}
