"""The thirty labelled utterances: id, input, dialect, code-mixed, normalised, intent."""

ROWS = """
1|Dei nalaiku assignment submit panna remind pannu|Chennai|t|Remind me to submit my assignment tomorrow.|set_reminder
2|Machi inniku evening gym poga remind pannu|Chennai|t|Remind me to go to the gym this evening.|set_reminder
3|Naalaikku kaalaila 6 maniku alarm vai|Standard Tamil|t|Set an alarm for 6 in the morning tomorrow.|set_alarm
4|Amma ku call pannu|Standard Tamil|t|Call mother.|make_call
5|Thambi ku oru message anuppu naan late ah varen nu|Madurai|t|Send a message to my brother that I will come late.|send_message
6|Semma song ondru podu|Chennai|f|Play a good song.|play_music
7|Inniku weather eppadi iruku|Standard Tamil|t|How is the weather today?|check_weather
8|WhatsApp open pannu da|Chennai|t|Open WhatsApp.|open_app
9|Coimbatore ku vazhi kaatu|Kongu|f|Show me directions to Coimbatore.|navigate
10|Volume konjam kammi pannu|Standard Tamil|t|Reduce the volume a little.|device_control
11|Anna nalaiku meeting iruku remind pannunga|Standard Tamil|t|Remind me that there is a meeting tomorrow.|set_reminder
12|Remind me to pay the electricity bill tomorrow|Indian English|f|Remind me to pay the electricity bill tomorrow.|set_reminder
13|Set an alarm for 5:30 am|Indian English|f|Set an alarm for 5:30 am.|set_alarm
14|Appa ku phone pottu kudu|Nellai|f|Call father.|make_call
15|Ilayaraja paatu podu la|Kongu|f|Play Ilayaraja song.|play_music
16|Naalaikku mazhai varuma|Standard Tamil|f|Will it rain tomorrow?|check_weather
17|Camera open pannu sikkiram|Standard Tamil|t|Open the camera quickly.|open_app
18|Office ku route sollu bruh|Chennai|t|Show me the route to the office.|navigate
19|Brightness konjam koothu|Standard Tamil|t|Increase the brightness a little.|device_control
20|Ava enna panra ipo|Chennai|f|What are you doing now?|smalltalk
21|Vanakkam AVA eppadi iruka|Standard Tamil|f|Hello AVA, how are you?|smalltalk
22|Bangalore population evlo nu search pannu|Standard Tamil|t|Search how much the population of Bangalore is.|search_info
23|Tomorrow morning ku 7 maniku alarm vai da|Chennai|t|Set an alarm for 7 tomorrow morning.|set_alarm
24|Sister ku message anuppu|Standard Tamil|t|Send a message to my sister.|send_message
25|Konjam music podu please|Standard Tamil|t|Play some music.|play_music
26|Ayya nalaiku medicine saapida remind pannunga|Kongu|t|Remind me to take medicine tomorrow.|set_reminder
27|Chennai la traffic eppadi iruku nu sollu|Chennai|t|Tell me how the traffic in Chennai is.|search_info
28|Wifi off pannu|Standard Tamil|t|Turn off the wifi.|device_control
29|Friend ku call pottu kudu pa|Nellai|t|Call my friend.|make_call
30|Play some Tamil songs please|Indian English|f|Play some Tamil songs.|play_music
"""


def rows():
    return [(int(a), b, c, d == "t", e, f) for a, b, c, d, e, f in (x.split("|") for x in ROWS.strip().splitlines())]


def frame(spark):
    return spark.createDataFrame(rows(), "id int, text string, dialect_label string, code_mix boolean, expected string, intent_label string")
