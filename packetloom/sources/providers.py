"""Built-in resolvers that speak DNS over HTTPS or TLS."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Domains of known DNS-over-HTTPS providers.
DOH = """dns.google cloudflare-dns.com mozilla.cloudflare-dns.com security.cloudflare-dns.com family.cloudflare-dns.com dns.quad9.net dns11.quad9.net dns.adguard.com
dns.nextdns.io doh.opendns.com resolver1.opendns.com dns.cleanbrowsing.org dns0.eu dns.sb doh.mullvad.net dns.controld.com doh.libredns.gr doh.crypto.sx dns.switch.ch
dns.digitale-gesellschaft.ch dns.comcast.net doh.att.net doh.verizon.com doh.orange.fr doh.telekom.de doh.telenor.net doh.tele2.net doh.bt.com doh.sky.com doh.kpn.net
doh.swisscom.ch doh.proximus.be doh.movistar.es doh.tim.it doh.vodafone.de doh.vodafone.co.uk dns.umbrella.com doh.cisco.com doh.zscaler.com doh.paloaltonetworks.com
doh.fortinet.com doh.akamai.net secure-dns.sophos.com doh.checkpoint.com doh.forcepoint.com unicast.censurfridns.dk anycast.censurfridns.dk resolver-eu.lelux.fi
dns.alidns.com dns.yandex.net doh.360.cn doh.tiar.app doh.appliedprivacy.net doh.securedns.eu doh.blahdns.com doh.rzone.de dns.fdn.fr doh.li doh.opendns.fr
doh.kdatacenter.com doh.joindns4.eu doh.uncensoreddns.org doh.cz.nic dns.nlnetlabs.nl resolver.freedns.zone""".split()
# Domains of known DNS-over-TLS providers.
DOT = """dns.google cloudflare-dns.com dns.quad9.net dns11.quad9.net dns.adguard.com dns.nextdns.io dns.cleanbrowsing.org dns0.eu dns.switch.ch dns.sb doh.mullvad.net
dns.controld.com dns.digitale-gesellschaft.ch unicast.censurfridns.dk anycast.censurfridns.dk dns.fdn.fr doh.li dns.nlnetlabs.nl resolver.freedns.zone""".split()


def providers(spark: SparkSession, kind: str, learned: DataFrame | None = None) -> DataFrame:
    """domain: the built-in list and, if given, learned domains."""
    out = spark.createDataFrame([(d,) for d in (DOH if kind == "doh" else DOT)], "domain string")
    return out if learned is None else out.union(learned.select("domain")).distinct()
