"""Stop words of the pipelines: lists by language and category. They need no session, so plans can be built anywhere."""

from __future__ import annotations

# English function words.
ENGLISH = """
a an the this that these those some any each every either neither no none other another such same own
i me my mine myself we us our ours ourselves you your yours yourself he him his himself she her hers herself
it its itself they them their theirs themselves who whom whose which what when where why how
and or but nor so yet if then else because as while until although though since unless than whether
of at by for with about against between into through during before after above below to from up down in out on off
over under again further once here there all both few more most only very too just also not
am is are was were be been being have has had having do does did doing can could may might must shall should will would
still even ever never now already almost always often perhaps quite rather really
""".split()
# Spanish function words without accents and with them.
SPANISH = """
el la los las un una unos unas lo al del de a ante bajo con contra desde en entre hacia hasta para por segun según sin sobre tras
y e o u ni que pero si sí no porque como cuando donde quien cual cuyo mas más muy ya tambien también aun aún asi así
yo tu tú el él ella ello nosotros vosotros ellos ellas me te se nos os le les mi mis su sus nuestro nuestra este esta esto
ese esa eso aquel aquella ser es soy eres somos son era fue fueron sido estar esta está estan están estaba haber ha he han habia había
""".split()
# Chinese function words.
CHINESE = "的 了 和 是 在 我 你 他 她 它 我们 你们 他们 这个 那个 这些 那些 一个 一种 这样 那样 然后 但是 所以 因为 如果 就是 还是 没有 不是 可能 可以 感觉 觉得 比较".split()
# Words of a travel corpus that say little about a topic, by language and category.
CORPUS = {
    "en": "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december day week month year today tomorrow yesterday hotel room stay really actually basically okay yeah gonna wanna like video channel subscribe".split(),
    "es": "lunes martes miercoles jueves viernes sabado domingo enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre dia semana mes año hoy mañana ayer hotel habitacion realmente siempre tambien".split(),
    "zh": "星期 一月 二月 三月 四月 五月 六月 今天 明天 昨天 酒店 房间 吧 吗 呢 啊".split(),
}

def base(language: str) -> list[str]:
    """Stop words of ``en``, ``es``, ``zh`` or ``mixed`` in order."""
    out: set[str] = set()
    if language in ("en", "mixed"):
        out |= set(ENGLISH)
    if language == "es":
        out |= set(SPANISH)
    if language in ("zh", "mixed"):
        out |= set(CHINESE)
    return sorted(out)


def academic(language: str, extra: list[str] | None = None) -> list[str]:
    return sorted(set(base(language)) | set(CORPUS.get(language, [])) | set(extra or []))
