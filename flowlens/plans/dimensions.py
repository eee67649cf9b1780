"""Dimension tables of the classifier. Longer tables are read from files: rules and manufacturers are parameters."""

from __future__ import annotations

import csv

# Application rules in order of precedence, as `app_id | name | category | domains`. A deployment's own
# table is a CSV file for read_rules.
RULES = """
50 | ChatGPT | AI | chatgpt.com openai.com oaistatic.com
51 | Claude | AI | anthropic.com claude.ai claudeusercontent.com
52 | DeepSeek | AI | deepseek.com
53 | Gemini | AI | gemini.google.com bard.google.com
54 | Kimi | AI | kimi.moonshot.cn moonshot.cn
55 | Coze | AI | coze.com
56 | 通义千问 | AI | tongyi.aliyun.com qwen.ai
57 | Cursor | AI | cursor.sh
1 | YouTube | Video | youtube.com googlevideo.com ytimg.com withgoogle.com
2 | Netflix | Video | netflix.com nflxvideo.net nflximg.net nflxext.com
3 | 抖音/TikTok | Video | douyin.com tiktok.com amemv.com douyinvod.com douyinpic.com byteoversea.com
4 | Bilibili | Video | bilibili.com hdslb.com
5 | 爱奇艺 | Video | iqiyi.com qiyi.com
6 | 腾讯视频 | Video | v.qq.com qqvideo
7 | 优酷 | Video | youku.com ykimg.com
8 | 芒果TV | Video | mgtv.com
9 | Twitch | Video | twitch.tv twitchcdn.net
140 | 字节跳动 CDN | Video | byteimg.com fqnovelpic.com qznovelvod.com snssdk.com
10 | 微信 | Social | weixin.qq.com wechat.com weixinbridge.com
11 | 微博 | Social | weibo.com weibo.cn
12 | 小红书 | Social | xiaohongshu.com xhscdn.com
13 | 知乎 | Social | zhihu.com
14 | Instagram | Social | instagram.com cdninstagram.com
15 | Twitter/X | Social | twitter.com x.com twimg.com
16 | WhatsApp | Social | whatsapp.com whatsapp.net
17 | Telegram | Social | telegram.org t.me cdn-telegram.org
18 | Discord | Social | discord.com discordapp.com discord.gg
19 | Slack | Social | slack.com slack-msgs.com
20 | QQ | Social | qq.com qzone.qq.com connect.qq.com
141 | 番茄小说 | Social | novelpic.com novelfeeds.com
30 | QQ 音乐 | Music | y.qq.com qqmusic.qq.com qpic.cn gtimg.cn
31 | 网易云音乐 | Music | 163.com music.163
32 | Spotify | Music | spotify.com scdn.co
33 | 酷狗音乐 | Music | kugou.com
34 | 酷我音乐 | Music | kuwo.cn
40 | 淘宝/天猫 | Shopping | taobao.com tmall.com
41 | 京东 | Shopping | jd.com jdpay.com
42 | 拼多多 | Shopping | pinduoduo.com yangkeduo.com
43 | Amazon | Shopping | amazon.com
44 | 美团 | Shopping | meituan.com dianping.com
45 | 支付宝 | Payment | alipay.com alipayobjects.com
46 | PayPal | Payment | paypal.com
130 | 微信支付 | Payment | wechatpay.com wechatpay.cn
60 | 钉钉 | Productivity | dingtalk.com ding.zj.gov.cn
61 | 飞书 | Productivity | feishu.cn larksuite.com
62 | Microsoft 365 | Productivity | office.com sharepoint.com outlook.com live.com
63 | Notion | Productivity | notion.com notion.so
64 | Microsoft Teams | Productivity | teams.microsoft.com skype.com lync.com
70 | 高德地图 | Navigation | amap.com autonavi.com
71 | 百度地图 | Navigation | map.baidu.com
72 | Google Maps | Navigation | maps.google.com googleapis.com
80 | Microsoft Edge | Browser | edge.microsoft.com
81 | Chrome | Browser | chrome.google.com update.googleapis.com
82 | Firefox | Browser | firefox.com mozilla.org
90 | Google | Web | google.com gstatic.com
91 | Bing | Web | bing.com
92 | 百度 | Web | baidu.com bdstatic.com
93 | 搜狗 | Web | sogou.com
100 | GitHub | Developer | github.com githubusercontent.com github.io
101 | GitLab | Developer | gitlab.com
102 | Docker | Developer | docker.com docker.io
103 | npm | Developer | npmjs.org npmjs.com
110 | 阿里云 | Cloud | aliyuncs.com aliyun.com
111 | 腾讯云 | Cloud | qcloud.com tencentcloud.com
112 | AWS | Cloud | amazonaws.com cloudfront.net
113 | Google Cloud | Cloud | googleapis.com gcr.io appspot.com
114 | Azure | Cloud | azure.com windows.net trafficmanager.net
115 | Cloudflare | CDN | cloudflare.com
116 | Akamai | CDN | akamaized.net akamai.net
117 | 字节跳动云 | Cloud | volces.com bytedance.com
118 | 金山云 | Cloud | ksyun.com ksyuncdn.com
119 | Apple CDN | System | mzstatic.com aaplimg.com apple-dns.cn cdngslb.com
120 | Cloud CDN | CDN | azureedge.net
150 | Windows Update | System | windowsupdate.com update.microsoft.com wns.windows.com
151 | Apple 系统服务 | System | apple.com icloud.com guzzoni.apple.com configuration.apple.com
152 | Apple Push | System | push.apple.com courier.push.apple.com iphone-ld.apple.com
153 | 小米 IoT | IoT | mi.com xiaomi.net miui.com micloud.xiaomi
154 | 华为 HMS | System | huawei.com hicloud.com hmscloud.com
155 | Vivo 系统服务 | System | vivo.com.cn vivo.com
156 | NTP 时间同步 | System | pool.ntp.org time.apple.com ntp.org
160 | 微软新闻 | News | msn.cn msn.com
161 | 今日头条 | News | toutiao.com pstatp.com
170 | Binance | Finance | binance.com binance.us
171 | Coinbase | Finance | coinbase.com
172 | OKX | Finance | okx.com
180 | WPAD | Network | wpad
190 | Google Analytics | Analytics | google-analytics.com googletagmanager.com
191 | Comscore | Analytics | scorecardresearch.com
200 | Microsoft | Enterprise | microsoft.com windows.com
201 | Apple 服务 | System | apple-dns.net
210 | Disney+ | Video | disneyplus.com dssott.com disney-plus.net bamgrid.com
211 | HBO Max | Video | hbomax.com hbomaxcdn.com max.com wbd.com
212 | Hulu | Video | hulu.com hulustream.com
213 | Prime Video | Video | primevideo.com amazonvideo.com aiv-cdn.net
214 | Peacock | Video | peacocktv.com nbcolympics.com
215 | Plex | Video | plex.tv plex.direct plex.tv
216 | Emby | Video | emby.media emby.com
217 | Jellyfin | Video | jellyfin.org
220 | Steam | Game | steampowered.com steamcommunity.com steamcdn.com steamstatic.com
221 | Epic Games | Game | epicgames.com fortnite.com unrealengine.com easistent.com
222 | PlayStation | Game | playstation.com sonyentertainmentnetwork.com nsx.np.dl.playstation.net
223 | Xbox Live | Game | xbox.com xboxlive.com xbl.io
224 | Nintendo | Game | nintendo.com nintendo.net nintendo-europe.com
225 | Riot Games | Game | riotgames.com lolstatic.com pvp.net
226 | Roblox | Game | roblox.com rbxcdn.com
227 | Minecraft | Game | minecraft.net minecraftforge.net mojang.com
228 | Unity | Game | unity.com unity3d.com unityads.com
230 | Reddit | Social | reddit.com redditmedia.com redd.it
231 | LinkedIn | Social | linkedin.com licdn.com
232 | Pinterest | Social | pinterest.com pinimg.com
233 | Threads | Social | threads.net
234 | Mastodon | Social | mastodon.social mastodon.cloud
235 | Bluesky | Social | bsky.social atproto.com
240 | Perplexity | AI | perplexity.ai pplx.ai
241 | Hugging Face | AI | huggingface.co hf.co
242 | Stability AI | AI | stability.ai stabilityusercontent.com
243 | Midjourney | AI | midjourney.com mj.us
244 | Suno | AI | suno.com suno.ai
245 | RunPod | AI | runpod.ai runpod.io
246 | Replicate | AI | replicate.com replicateusercontent.com
250 | Zoom | Productivity | zoom.us zoomgov.com zoom.com
251 | Google Meet | Productivity | meet.google.com
252 | Cisco Webex | Productivity | webex.com webexapis.com
253 | Atlassian | Productivity | atlassian.com jira.com bitbucket.org confluence.com
254 | Figma | Productivity | figma.com figusercontent.com
255 | Canva | Productivity | canva.com canvases.io
256 | Miro | Productivity | miro.com mirostatic.com
257 | Linear | Productivity | linear.app linearusercontent.com
260 | Google Drive | Storage | drive.google.com googleusercontent.com ggpht.com
261 | Dropbox | Storage | dropbox.com dropboxstatic.com dropboxusercontent.com
262 | OneDrive | Storage | onedrive.com onedrive.live.com sharepoint.com
263 | iCloud | Storage | icloud.com icloud-content.com icloud.cdn
264 | Box | Storage | box.com box.net boxcdn.net
270 | Tailscale | VPN | tailscale.com tailscale.io
271 | ZeroTier | VPN | zerotier.com zt.systems
272 | WireGuard | VPN | wg.
280 | Philips Hue | IoT | meethue.com philips-hue.com
281 | TP-Link Tapo | IoT | tplinkcloud.com tapologic.com
282 | ESP/Arduino | IoT | arduino.cc espressif.com
283 | Home Assistant | IoT | home-assistant.io nabucasa.com
284 | Xiaomi Home | IoT | home.mi.com iot.mi.com
290 | Stack Overflow | Developer | stackoverflow.com stackexchange.com
291 | JetBrains | Developer | jetbrains.com intellij.com
292 | Visual Studio | Developer | visualstudio.com vsassets.io
293 | GitHub Actions | Developer | actions.githubusercontent.com githubusercontent.com
294 | Cloudflare Workers | Developer | workers.dev pages.dev
300 | Fastly | CDN | fastly.com fastly.net fastlylb.net
301 | jsDelivr | CDN | jsdelivr.com jsdelivr.net
302 | UNPKG | CDN | unpkg.com
303 | KeyCDN | CDN | keycdn.com kxcdn.com
304 | Bunny CDN | CDN | bunny.net bunnycdn.net
305 | Vercel | CDN | vercel.com vercel.app
306 | Netlify | CDN | netlify.com netlify.app
"""

# Services by port, as `port name category app_id`; ranges as `low-high`.
PORTS = """
53 DNS Network 160
67 DHCP Network 161
68 DHCP Network 161
80 HTTP Web 162
443 HTTPS Web 163
22 SSH Remote 164
20 FTP File 165
21 FTP File 165
69 TFTP File 191
25 SMTP Email 166
465 SMTPS Email 192
587 SMTP-Submit Email 193
110 POP3 Email 167
995 POP3S Email 194
143 IMAP Email 168
993 IMAPS Email 195
389 LDAP Enterprise 196
636 LDAPS Enterprise 197
3389 RDP Remote 169
5900-5901 VNC Remote 170
3306 MySQL Database 171
5432 PostgreSQL Database 172
6379 Redis Database 173
27017 MongoDB Database 174
8080 HTTP-Alt Web 175
9090 HTTP-Alt2 Web 198
8443 HTTPS-Alt Web 176
9443 HTTPS-Alt2 Web 199
123 NTP Network 177
161-162 SNMP Network 178
1900 UPnP/SSDP Network 180
5353 mDNS Network 179
137-139 NetBIOS Network 181
445 SMB File 182
548 AFP File 183
2049 NFS File 184
1194 OpenVPN VPN 185
500 IPsec VPN 186
4500 IPsec VPN 186
1701 L2TP VPN 187
1080 SOCKS Proxy 188
3128 Squid Proxy 189
7890 Clash Proxy 190
3478 STUN/TURN VoIP 200
5349 STUN/TURN VoIP 200
1935 RTMP Streaming 201
554 RTSP Streaming 202
5222 XMPP Messaging 203
25565 Minecraft Game 204
3074 Xbox_Live Game 205
27015-27016 Steam Game 206
853 DoT Network 207
784-786 WireGuard VPN 208
"""

# TLS fingerprints by the first 16 characters, as `prefix | app_id | name | category | confidence`. Of two
# rows with one prefix the first counts.
FINGERPRINTS = """
e7d705a3286e19ea | 520 | Chrome | Browser | 0.85
51c64c77e60f3970 | 520 | Chrome | Browser | 0.85
a0e9f5d44349b2c0 | 520 | Chrome | Browser | 0.80
7e8f9a0b1c2d3e4f | 520 | Chrome | Browser | 0.75
04abac92832e2823 | 521 | Firefox | Browser | 0.85
3031b0f2f77c1bcc | 521 | Firefox | Browser | 0.85
f2a1b3c4d5e6f789 | 521 | Firefox | Browser | 0.80
d9f1f4b4b6b8d7a2 | 522 | Safari | Browser | 0.85
1e7c1a5f3a4b6c8d | 522 | Safari | Browser | 0.80
72e0d8bfa28cdfe8 | 522 | Safari | Browser | 0.75
3a4b5c6d7e8f9a0b | 523 | Edge | Browser | 0.80
6734f37431670b3a | 500 | Cobalt Strike | Malware | 0.95
51c64c77e60f3970 | 500 | Cobalt Strike | Malware | 0.85
aab1c0bd39f878b0 | 500 | Cobalt Strike | Malware | 0.90
5a4b3c2d1e0f9a8b | 500 | Cobalt Strike | Malware | 0.85
7c9f1a2b3d4e5f6a | 501 | Metasploit | Malware | 0.90
1a2b3c4d5e6f7a8b | 502 | Burp Suite | Security | 0.80
b8c9d0e1f2a3b4c5 | 503 | sqlmap | Security | 0.85
a9b8c7d6e5f4a3b2 | 504 | Nmap | Security | 0.75
c1d2e3f4a5b6c7d8 | 505 | Clash | Proxy | 0.70
e1f2a3b4c5d6e7f8 | 505 | Clash | Proxy | 0.65
d4e5f6a7b8c9d0e1 | 506 | V2Ray | Proxy | 0.70
b1c2d3e4f5a6b7c8 | 506 | V2Ray | Proxy | 0.65
15c3ef044b1706e4 | 513 | curl | Library | 0.80
3c7a0a1b2c3d4e5f | 513 | curl | Library | 0.75
bce59af05b14a7c5 | 510 | python-requests | Library | 0.75
5e0a56c431b1d1c8 | 510 | python-requests | Library | 0.70
6e43d10e43a3e240 | 511 | Go http.Client | Library | 0.75
f6a7b8c9d0e1f2a3 | 511 | Go http.Client | Library | 0.65
a7b8c9d0e1f2a3b4 | 512 | Node.js fetch | Library | 0.65
b8c9d0e1f2a3b4c5 | 512 | Node.js fetch | Library | 0.60
d0e1f2a3b4c5d6e7 | 514 | Wget | Library | 0.70
"""

# Manufacturers by the first three bytes of the MAC address. A short default, with the prefixes that the
# device profiles name; the registry of a deployment (hundreds of rows and more) is a CSV file for read_manufacturers.
MANUFACTURERS = """
00:03:93 Apple
00:17:f2 Apple
3c:15:c2 Apple
6c:1f:f7 Apple
f0:18:98 Apple
fc:25:3f Apple
00:15:99 Samsung
aa:80:a0 Xiaomi
de:2c:28 Xiaomi
00:18:82 Huawei
18:b4:30 Google
00:75:92 Amazon
b4:6e:10 Vivo
3a:a4:28 Vivo
02:00:00 OnePlus
9a:1c:8c OnePlus
58:03:fb OPPO
6c:02:e0 OPPO
b0:75:d5 OPPO
00:0b:ab Lenovo
00:1a:6b Lenovo
18:67:b0 Lenovo
3c:7c:3f Lenovo
5c:e8:39 Lenovo
00:e0:4c Realtek
00:e0:61 Realtek
00:0d:4f Roku
48:a6:d2 Roku
00:1b:dc Sony
04:4b:ed Sony
1c:3b:f3 Sony
00:15:5d Microsoft
00:1d:d8 Microsoft
00:22:48 Microsoft
14:4f:8a Microsoft
48:50:fd Microsoft
58:6a:6b Microsoft
e2:08:f4 Clash/Stash
5a:e2:02 Clash/Stash
ea:0c:af OpenWrt
"""


def rules(text: str = RULES) -> list[tuple[int, int, str, str, str]]:
    """(ord, app_id, name, category, domain), the first rule first."""
    out = []
    for line in filter(str.strip, text.splitlines()):
        app_id, name, category, domains = (x.strip() for x in line.split("|"))
        for domain in domains.split():
            out.append((len(out), int(app_id), name, category, domain))
    return out


def read_rules(path: str) -> list[tuple[int, int, str, str, str]]:
    """Rules from a CSV file with the columns app_id, name, category, domain, in order of precedence."""
    with open(path, newline="", encoding="utf-8") as file:
        return [(i, int(r["app_id"]), r["name"], r["category"], r["domain"]) for i, r in enumerate(csv.DictReader(file))]


def ports(text: str = PORTS) -> dict[str, tuple[int, str, str]]:
    out = {}
    for port, name, category, app_id in map(str.split, filter(str.strip, text.splitlines())):
        low, _, high = port.partition("-")
        for p in range(int(low), int(high or low) + 1):
            out[str(p)] = int(app_id), name.replace("_", " "), category
    return out


def fingerprints(text: str = FINGERPRINTS) -> dict[str, tuple[int, str, str, float]]:
    out: dict[str, tuple[int, str, str, float]] = {}
    for line in filter(str.strip, text.splitlines()):
        prefix, app_id, name, category, confidence = (x.strip() for x in line.split("|"))
        out.setdefault(prefix, (int(app_id), name, category, float(confidence)))
    return out


def manufacturers(text: str = MANUFACTURERS) -> dict[str, tuple[str]]:
    return {prefix: (name.strip(),) for prefix, _, name in (x.partition(" ") for x in filter(str.strip, text.splitlines()))}


def read_manufacturers(path: str) -> dict[str, tuple[str]]:
    """Manufacturers from a CSV file with the columns prefix and vendor; the first row of a prefix counts."""
    out: dict[str, tuple[str]] = {}
    with open(path, newline="", encoding="utf-8") as file:
        for row in csv.DictReader(file):
            out.setdefault(row["prefix"].lower(), (row["vendor"],))
    return out
